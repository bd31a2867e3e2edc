"""Hard filters, fit scores, ratings, actions and the decision report."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestead import catalog as cat
from lodestead.checkpoints import cut
from lodestead.functions.numbers import round_even
from lodestead.operators import decision, merge, price_model, score
from lodestead.operators.nearest import nearest_wide
from lodestead.operators.people import score_people, tables_of
from lodestead.plans.report import build_report
from lodestead.queries.registry import query
from lodestead.queries.views import view
from lodestead.sources.preferences import HardFilter, Preferences
from lodestead.sources.tables import conform


def _rules(**rules: object) -> list[HardFilter]:
    return [HardFilter.parse(k, v) for k, v in rules.items()]


ALICE = Preferences(
    "alice",
    _rules(
        max_weekly_rent_aud=1200.0, min_bedrooms=2.0, max_commute_transit_minutes=60.0, allowed_suburb=[],
        excluded_suburb=["Brand#12", "Brand#34"], pet_friendly_required=False,
    ),
    {
        "weekly_rent_aud": -0.6, "preferred_suburbs": 0.5, "commute_transit_minutes": -0.5, "air_conditioning": 0.5,
        "bedrooms": 0.3, "floor_size_sqm": 0.4, "pool": 0.2, "bathrooms": 0.0, "no_such_column": 0.9,
    },
    ["Brand#11", "Brand#23", "Brand#45"],
)
BOB = Preferences(
    "bob",
    _rules(
        min_lease_term_months=12.0, allowed_suburb=["Brand#11", "Brand#12", "Brand#21", "Brand#22", "Brand#31", "Brand#32"],
        air_conditioning_required=True, max_no_such_column=3.0,
    ),
    {
        "bathrooms": 0.7, "pet_friendly": 0.4, "fits_two_desks_3rd_bedroom": 0.6, "lease_term_months": 0.2,
        "weekly_rent_aud": -0.1,
    },
)
PEOPLE = [ALICE, BOB]
NAMES = ["alice", "bob"]

# The same preferences spelled out for the checking engine.
SCORES_SQL = """ranges AS (
  SELECT min(weekly_rent_aud) rent_lo, max(weekly_rent_aud) rent_hi,
    min(commute_transit_minutes) tr_lo, max(commute_transit_minutes) tr_hi,
    min(bedrooms) bed_lo, max(bedrooms) bed_hi, min(bathrooms) bath_lo, max(bathrooms) bath_hi,
    min(lease_term_months) lease_lo, max(lease_term_months) lease_hi
  FROM v_listings
), parts AS (
  SELECT l.*,
    coalesce((weekly_rent_aud - rent_lo) / (rent_hi - rent_lo), 0.5) AS s_rent,
    coalesce((commute_transit_minutes - tr_lo) / (tr_hi - tr_lo), 0.5) AS s_tr,
    coalesce(CAST(bedrooms - bed_lo AS DOUBLE) / CAST(bed_hi - bed_lo AS DOUBLE), 0.5) AS s_bed,
    coalesce(CAST(bathrooms - bath_lo AS DOUBLE) / CAST(bath_hi - bath_lo AS DOUBLE), 0.5) AS s_bath,
    coalesce(CAST(lease_term_months - lease_lo AS DOUBLE) / CAST(lease_hi - lease_lo AS DOUBLE), 0.5) AS s_lease
  FROM v_listings l, ranges
), raws AS (
  SELECT listing_id, 'alice' AS person,
    concat_ws('; ',
      CASE WHEN weekly_rent_aud > 1200 THEN concat('weekly_rent_aud = ', CAST(weekly_rent_aud AS VARCHAR), ' > max 1200.0') END,
      CASE WHEN bedrooms < 2 THEN concat('bedrooms = ', CAST(bedrooms AS VARCHAR), ' < min 2.0') END,
      CASE WHEN commute_transit_minutes > 60 THEN concat('commute_transit_minutes = ', CAST(commute_transit_minutes AS VARCHAR), ' > max 60.0') END,
      CASE WHEN suburb IN ('Brand#12', 'Brand#34') THEN concat('suburb = ''', suburb, ''' is in excluded list [''Brand#12'', ''Brand#34'']') END
    ) AS hard_filter_reasons,
    0e0 + -0.6e0 * s_rent
      + 0.5e0 * CASE WHEN suburb IN ('Brand#11', 'Brand#23', 'Brand#45') THEN 1e0 ELSE 0e0 END
      + -0.5e0 * s_tr + 0.5e0 * coalesce(CAST(air_conditioning AS DOUBLE), 0.5e0) + 0.3e0 * s_bed
      + 0.4e0 * 0.5e0 + 0.2e0 * CAST(pool AS DOUBLE) AS raw
  FROM parts
  UNION ALL
  SELECT listing_id, 'bob',
    concat_ws('; ',
      CASE WHEN lease_term_months < 12 THEN concat('lease_term_months = ', CAST(lease_term_months AS VARCHAR), ' < min 12.0') END,
      CASE WHEN suburb NOT IN ('Brand#11', 'Brand#12', 'Brand#21', 'Brand#22', 'Brand#31', 'Brand#32')
        THEN concat('suburb = ''', suburb, ''' not in allowed [''Brand#11'', ''Brand#12'', ''Brand#21'', ''Brand#22'', ''Brand#31'', ''Brand#32'']') END,
      CASE WHEN NOT coalesce(air_conditioning <> 0, false) THEN 'air_conditioning required but missing/false' END
    ),
    0e0 + 0.7e0 * s_bath + 0.4e0 * CAST(pet_friendly AS DOUBLE) + 0.6e0 * 0.5e0 + 0.2e0 * s_lease + -0.1e0 * s_rent
  FROM parts
), scores AS (
  SELECT listing_id, r.person, hard_filter_reasons = '' AS hard_filter_pass, hard_filter_reasons,
    raw, round_even((raw - lo) / (hi - lo) * 10e0 * 10e0, 0) / 10e0 AS fit_score
  FROM raws r JOIN (SELECT person, min(raw) lo, max(raw) hi FROM raws GROUP BY person) x ON r.person = x.person
)"""
RATINGS_SQL = """latest AS (
  SELECT listing_id, person, score, comment FROM (
    SELECT *, row_number() OVER (PARTITION BY listing_id, person ORDER BY rated_at DESC, seq DESC) AS rn FROM v_ratings
  ) WHERE rn = 1
), wide AS (
  SELECT listing_id,
    max(CASE WHEN person = 'alice' THEN score END) AS alice_rating, max(CASE WHEN person = 'alice' THEN comment END) AS alice_comment,
    max(CASE WHEN person = 'bob' THEN score END) AS bob_rating, max(CASE WHEN person = 'bob' THEN comment END) AS bob_comment
  FROM latest GROUP BY listing_id
)"""
WIDE_SCORES_SQL = """people AS (
  SELECT listing_id,
    bool_or(hard_filter_pass) FILTER (WHERE person = 'alice') AS alice_hard_filter_pass,
    max(fit_score) FILTER (WHERE person = 'alice') AS alice_fit_score,
    bool_or(hard_filter_pass) FILTER (WHERE person = 'bob') AS bob_hard_filter_pass,
    max(fit_score) FILTER (WHERE person = 'bob') AS bob_fit_score
  FROM scores GROUP BY listing_id
), judged AS (
  SELECT l.*, alice_hard_filter_pass, alice_fit_score, bob_hard_filter_pass, bob_fit_score,
    alice_rating, alice_comment, bob_rating, bob_comment,
    CASE WHEN trim(coalesce(status, '')) <> '' THEN status
      WHEN NOT alice_hard_filter_pass OR NOT bob_hard_filter_pass
        THEN concat('skip -- hard filter failed (', concat_ws(', ', CASE WHEN NOT alice_hard_filter_pass THEN 'alice' END, CASE WHEN NOT bob_hard_filter_pass THEN 'bob' END), ')')
      WHEN alice_rating IS NULL OR bob_rating IS NULL THEN 'awaiting rating'
      WHEN abs(alice_rating - bob_rating) >= 3 THEN 'discuss -- scores diverge'
      WHEN alice_rating >= 7 AND bob_rating >= 7 THEN 'worth inspecting'
      WHEN alice_rating < 4 AND bob_rating < 4 THEN 'skip -- low rating'
      ELSE 'maybe' END AS suggested_action,
    CASE WHEN alice_fit_score = 0 OR bob_fit_score = 0 THEN 0e0
      ELSE round_even(2e0 / (1e0 / alice_fit_score + 1e0 / bob_fit_score) * 10e0, 0) / 10e0 END AS combined_fit_score
  FROM v_listings l JOIN people USING (listing_id) LEFT JOIN wide USING (listing_id)
)"""


def _with(*parts: str) -> str:
    """Table expressions followed by the query over them."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


@query(
    "fit_scores_long",
    _with(SCORES_SQL,
          "SELECT listing_id, person, hard_filter_pass, hard_filter_reasons, round(raw, 6) AS raw_score, fit_score FROM scores"),
)
def fit_scores_long(spark, sf_dir):
    long = score_people(conform(view(spark, sf_dir, "v_listings")), *tables_of(spark, PEOPLE))
    return long.withColumn("raw_score", F.round("raw_score", 6))


@query(
    "feature_ranges",
    """SELECT min(bathrooms) * 1e0 AS bathrooms_lo, max(bathrooms) * 1e0 AS bathrooms_hi,
      min(commute_transit_minutes) AS commute_transit_minutes_lo, max(commute_transit_minutes) AS commute_transit_minutes_hi,
      min(floor_size_sqm) AS floor_size_sqm_lo, max(floor_size_sqm) AS floor_size_sqm_hi FROM v_listings""",
)
def feature_ranges(spark, sf_dir):
    return score.feature_ranges(view(spark, sf_dir, "v_listings"), ["bathrooms", "commute_transit_minutes", "floor_size_sqm"])


@query(
    "combined_fit",
    _with(SCORES_SQL, """SELECT listing_id, CASE WHEN min(fit_score) = 0 THEN 0e0
      ELSE round_even(count(*) / sum(CASE WHEN fit_score = 0 THEN NULL ELSE 1e0 / fit_score END) * 10e0, 0) / 10e0 END AS combined_fit_score
    FROM scores GROUP BY listing_id"""),
)
def combined_fit(spark, sf_dir):
    return score.combined_fit(score.score_all(conform(view(spark, sf_dir, "v_listings")), PEOPLE))


@query("ratings_latest", _with(RATINGS_SQL, "SELECT * FROM latest"))
def ratings_latest(spark, sf_dir):
    ratings = view(spark, sf_dir, "v_ratings")
    return merge.latest_per_key(ratings, ["listing_id", "person"], ["rated_at", "seq"]).drop("rated_at", "seq")


@query("ratings_wide", _with(RATINGS_SQL, "SELECT * FROM wide"))
def ratings_wide(spark, sf_dir):
    return decision.ratings_wide(view(spark, sf_dir, "v_ratings"), NAMES)


@query(
    "rating_spread",
    _with(RATINGS_SQL, """SELECT listing_id, max(score) - min(score) AS spread, min(score) >= 7 AS all_good,
      max(score) < 4 AS all_low, count(score) < 2 AS any_missing FROM latest GROUP BY listing_id"""),
)
def rating_spread(spark, sf_dir):
    return decision.rating_spread(ratings_latest(spark, sf_dir), NAMES)


def _judged(spark, sf_dir):
    scored = score.score_wide(conform(view(spark, sf_dir, "v_listings")), PEOPLE)
    return decision.with_ratings(scored, view(spark, sf_dir, "v_ratings"), NAMES)


@query(
    "suggested_actions",
    _with(SCORES_SQL, RATINGS_SQL, WIDE_SCORES_SQL,
          "SELECT listing_id, suggested_action FROM judged"),
)
def suggested_actions(spark, sf_dir):
    return _judged(spark, sf_dir).select("listing_id", decision.suggested_action(NAMES).alias("suggested_action"))


@query(
    "action_counts_ordered",
    _with(SCORES_SQL, RATINGS_SQL, WIDE_SCORES_SQL,
          """SELECT row_number() OVER (ORDER BY CASE suggested_action WHEN 'discuss -- scores diverge' THEN 0 WHEN 'worth inspecting' THEN 1
             WHEN 'maybe' THEN 2 WHEN 'awaiting rating' THEN 3 ELSE 4 END, suggested_action) AS place, suggested_action, n
             FROM (SELECT suggested_action, count(*) AS n FROM judged GROUP BY suggested_action)"""),
)
def action_counts_ordered(spark, sf_dir):
    from pyspark.sql import Window as W

    counts = suggested_actions(spark, sf_dir).groupBy("suggested_action").agg(F.count("*").alias("n"))
    # a handful of groups by now
    order = W.orderBy(decision.action_rank(F.col("suggested_action")), "suggested_action")
    return counts.withColumn("place", F.row_number().over(order).cast("long"))


ONE_FEATURE = price_model.Features(numeric=("bathrooms",), flagged=(), amenities=(), categorical=False)
# Ridge on one centred feature in closed form, one model per held-out fold.
FOLDS_SQL = """foldable AS (
  SELECT listing_id, weekly_rent_aud AS y, CAST(bathrooms AS DOUBLE) AS x,
    CAST(CAST(concat('0x', substr(md5(listing_id), 1, 8)) AS BIGINT) % 5 AS INT) AS fold
  FROM v_listings WHERE weekly_rent_aud IS NOT NULL
), fold_ids AS (SELECT DISTINCT fold AS k FROM foldable
), models AS (
  SELECT k, avg(y) AS my, avg(x) AS mx, covar_pop(y, x) * count(*) / (var_pop(x) * count(*) + 1) AS w
  FROM fold_ids JOIN foldable ON fold <> k GROUP BY k
), signal AS (
  SELECT listing_id, y AS weekly_rent_aud, my + w * (x - mx) AS predicted_weekly_rent FROM foldable JOIN models ON fold = k
)"""
REPORT_TAIL = """
SELECT j.listing_id, CAST(NULL AS VARCHAR) AS address, suburb, CAST(NULL AS VARCHAR) AS url, j.weekly_rent_aud, bedrooms,
  lease_term_months, CAST(NULL AS DATE) AS available_from, round_even(commute_transit_minutes * 100e0, 0) / 100e0 AS commute_transit_minutes,
  CAST(NULL AS DOUBLE) AS nearest_train_station_walk_minutes, CAST(NULL AS DOUBLE) AS nearest_rail_walk_minutes, status, suggested_action,
  combined_fit_score, alice_hard_filter_pass, alice_fit_score, alice_rating, alice_comment,
  bob_hard_filter_pass, bob_fit_score, bob_rating, bob_comment,
  round(predicted_weekly_rent, 1) AS predicted_weekly_rent,
  round((j.weekly_rent_aud - predicted_weekly_rent) / predicted_weekly_rent * 100, 0) + 0e0 AS pct_over_or_under
FROM judged j LEFT JOIN signal USING (listing_id)
ORDER BY CASE suggested_action WHEN 'discuss -- scores diverge' THEN 0 WHEN 'worth inspecting' THEN 1 WHEN 'maybe' THEN 2
  WHEN 'awaiting rating' THEN 3 ELSE 4 END, j.listing_id"""


@query(
    "decision_report",
    _with(SCORES_SQL, RATINGS_SQL, WIDE_SCORES_SQL, FOLDS_SQL, REPORT_TAIL),
)
def decision_report(spark, sf_dir):
    """The whole report with a one-feature price model, which SQL can say too.
    The two model columns are shown coarser, as their last digits differ."""
    listings = conform(view(spark, sf_dir, "v_listings"))
    valued = price_model.with_price_signal(listings, features=ONE_FEATURE)
    scored = score.score_wide(valued, PEOPLE, population=listings)
    coarse = decision.with_ratings(scored, view(spark, sf_dir, "v_ratings"), NAMES).withColumns(
        {
            "pct_over_or_under": F.round(
                F.try_divide(F.col(cat.TARGET_COLUMN) - F.col("predicted_weekly_rent"), F.col("predicted_weekly_rent")) * 100, 0
            ) + F.lit(0.0),
            "predicted_weekly_rent": F.round("predicted_weekly_rent", 1),
        }
    )
    return decision.in_report_order(decision.decision_report(coarse, NAMES))


@query("decision_report_full")
def decision_report_full(spark, sf_dir):
    """The report with every feature and real nearest-point distances; its
    model has no SQL form and is checked against a closed form in the tests."""
    listings = nearest_wide(conform(view(spark, sf_dir, "v_listings", heavy=("part",))), view(spark, sf_dir, "v_poi"))
    # the ingest job stores listings with their nearest points; the report
    # starts from that table
    stored = cut(
        listings.withColumns(
            {f"nearest_{c}_walk_minutes": round_even(F.col(f"nearest_{c}_km") * 12.0, 2) for c in cat.RAIL_CATEGORIES}
        )
    )
    return build_report(stored, view(spark, sf_dir, "v_ratings"), PEOPLE)
