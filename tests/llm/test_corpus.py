"""Searches, joins and counts over documents against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lodestead.llm import bloomlm, decontaminate, pii, setjoin, sketch
from lodestead.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


# -- decontamination ----------------------------------------------------------


def hits(text, items):
    pattern = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    w = re.findall(pattern, lower(text))
    covered, found = set(), set()
    for item, body in items:
        v = re.findall(pattern, lower(body))
        n = min(10, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v and item is not None else set()
        for i in range(len(w) - n + 1):
            if windows and tuple(w[i : i + n]) in windows:
                covered |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(covered), sorted(found)


@pytest.mark.parametrize("rows", [50_000, 0])
def test_decontamination(spark, rows):
    a = " ".join(f"w{i}" for i in range(40))
    items = [(1, a), (2, "Short Item"), (3, a.upper()), (4, None), (None, "nameless item here"), (5, ""), (6, "é " * 12), (7, "x y z " * 5), (2, "Short Item")]
    texts = [
        None, "", " ", a, f"before {a} after", " ".join(a.split()[5:15]), " ".join(a.split()[5:14]), f"{a} gap {a}", "a SHORT, item! short item", "é " * 30, "é " * 9,
        "z x y " * 6, " ".join(reversed(a.split())), "w1 " * 4000 + a, "nameless item here",
    ]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)] + [(3, a, "x", 3), (None, a, None, None)], "doc_id long, text string, hash string, at int")
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("words", decontaminate.F.lit("x"))
    found = decontaminate.report(docs, benchmark, rows).collect()
    assert len(found) == len(texts) + 2
    for r in found:
        text = texts[r.doc_id] if r.doc_id is not None else a
        n, covered, own = hits(text, items)
        assert (r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) == (n, covered, len(own), own, covered > 0), text
    left = {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()}
    assert left == {i for i, t in enumerate(texts) if not hits(t, items)[1]}
    assert decontaminate.report(docs.limit(0), benchmark).count() == 0
    assert not any(r.contaminated for r in decontaminate.report(docs, benchmark.limit(0)).collect())


def test_decontamination_keeps_what_is_little_contaminated(spark):
    a = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, a), (1, "clean text"), (2, a + " other" * 100), (None, a), (3, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, a)], "item_id long, text string")
    left = decontaminate.clean(docs, benchmark, 0.5).collect()
    assert sorted(((r.doc_id or 0), len((r.text or "").split())) for r in left) == [(1, 2), (2, 112), (3, 0)]


def test_decontamination_is_linear_in_a_text(spark):
    import time

    benchmark = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20))), (2, "short item")], "item_id long, text string")

    def seconds(n):
        docs = spark.createDataFrame([(i, " ".join(f"Word{(j * j + i) % 5000}" for j in range(n))) for i in range(40)], "doc_id long, text string").repartition(4)
        began = time.perf_counter()
        assert {r.n_words for r in decontaminate.report(docs, benchmark).collect()} == {n}
        return time.perf_counter() - began

    seconds(100)
    assert seconds(20_000) < 12 * seconds(2_000)


def test_decontamination_twin(spark):
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    frame = QUERIES["op2_decontaminate"](spark, SMALL)
    columns = sorted(frame.columns)
    found = duck.execute(ORACLES["op2_decontaminate"])
    order = [[d[0] for d in found.description].index(c) for c in columns]
    assert sorted(map(tuple, frame.select(*columns).collect())) == sorted(tuple(r[i] for i in order) for r in found.fetchall())


# -- Jaccard join -------------------------------------------------------------


def classes(rows, size=4, percent=85):
    sets = []
    for _, text in rows:
        w = blank_words(text)
        n = min(size, len(w))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        r = find(i)
        if key is not None:
            least[r] = min(least.get(r, key), key)
    return [(key, len(s), least.get(find(i)) if s else key) for i, (key, s) in enumerate(zip((k for k, _ in rows), sets))]


def near_copies():
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in rng.integers(0, 400, 120)]
    rows, line = [], "this line stands in very many documents of the corpus".split()
    for i in range(150):  # near copies with up to three changed words, some far enough apart
        w = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 5)):
            w[p] = f"n{rng.integers(0, 10**6)}"
        rows.append((1000 + i, " ".join(w)))
    for i in range(60):
        rows.append((i, " ".join([f"u{x}" for x in rng.integers(0, 10**6, rng.integers(1, 60))] + line)))
    chain = [f"c{i}" for i in range(100)]
    for i in range(12):  # a chain of small steps
        rows.append((500 - i, " ".join(chain[2 * i :] + [f"d{j}" for j in range(2 * i)])))
    rows += [(700, None), (701, ""), (702, " \n"), (703, "one"), (704, "ONE"), (705, "one two"), (None, "one"), (703, "one"), (703, "other words here")]
    rows += [(800 + i, " ".join(base)) for i in range(20)]
    return rows


def test_jaccard_join(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "HOT", 8)
    rows = near_copies()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, class string").repartition(3)
    key = lambda r: tuple((x is None, x) for x in r)
    found = sorted(map(tuple, setjoin.similar(docs).collect()), key=key)
    assert found == sorted(classes(rows), key=key)
    assert setjoin.similar(docs.limit(0)).count() == 0


def test_jaccard_join_without_any_pruning(spark, monkeypatch):
    """Tables so small that they are full change nothing."""
    monkeypatch.setattr(setjoin, "SLOTS", 128)
    monkeypatch.setattr(setjoin, "MOST_WANTED", 128)
    monkeypatch.setattr(setjoin, "BLOCK", 7)
    monkeypatch.setattr("lodestead.llm.frames.BATCH_ROWS", 5)
    rows = near_copies()[:120]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, setjoin.similar(docs).collect())) == sorted(classes(rows))


def test_jaccard_join_of_groups_with_several_sets(spark):
    """Sets of equal size and prefix, of which only one stands for the others in the lists."""
    common = "this phrase stands before every passage".split()
    passages = {x: [f"{x}{i}" for i in range(60)] for x in "xy"}
    steps = [[f"z{i}" if i >= 5 * j else f"v{i}" for i in range(60)] for j in range(3)]  # neighbours link, the ends do not
    rows, orders = [], set()
    for passage in [*passages.values(), *steps]:
        for _ in range(25):
            rows.append((1000 + len(rows), " ".join([f"own{len(rows)}of{i}" for i in range(30)] + common + passage)))
    for k in range(8):
        own = [f"r{k}of{i}" for i in range(60)] + common
        a, b = own + passages["x"], own + passages["y"]
        sets = [next(setjoin._sets(setjoin.hash_words(*setjoin.utf8(pa.array([" ".join(t)]))), 4)) for t in (a, b)]
        orders.add(setjoin.signature(sets[0]) < setjoin.signature(sets[1]))
        rows += [(10 * k + i, " ".join(t)) for i, t in enumerate([a, b, b + ["end"]])]
        own = [f"s{k}of{i}" for i in range(60)] + common
        rows += [(10 * k + 5 + i, " ".join(t)) for i, t in enumerate([own + steps[0], own + steps[2], own + steps[1] + ["end"], own + steps[1] + ["tail"]])]
    assert orders == {True, False}
    expected = sorted(classes(rows))
    assert [c for key, _, c in expected if key < 9] == [0, 1, 1, 5, 5, 5, 5]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, setjoin.similar(docs).collect())) == expected


# -- PII ----------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(text):
    found = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card" and (not 12 <= len(digits) <= 19 or sum(d if j % 2 == 0 else 2 * d - 9 * (d > 4) for j, d in enumerate(reversed(digits))) % 10):
                continue
            found.append((m.start(), i, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_base_spans(spark):
    rng = np.random.default_rng(1)
    texts = [
        None, "", "a@b.c_d@e.f x@y.z@q.r", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.255 1.2.3", "+1 (555) 123-4567 +12345678 +1", "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000",
        "é@b.c ééé a.b+c@d-e.f.g.é 😀 x@y.zz 1.1.1.1", "+1+22 333 444 555+", "9" * 50000, "a." * 20000 + "@b.c", "a@" + "b." * 20000, "1 " * 30000, "+" + "1(" * 20000, "x" * 100000, "a@b.cc " * 300,
    ]
    texts += ["".join(rng.choice(list("a1.@+- 2(é"), 80)) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)] * 2, "doc_id long, text string, base string, spans int")
    found = pii.report(docs).collect()
    assert len(found) == 2 * len(texts)
    for r in found:
        expected = base(texts[r.doc_id])
        assert r.base == expected and r.spans == expected, texts[r.doc_id][:80]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [expected.count(k + ":") for k in PATTERNS]
    assert pii.report(docs.limit(0)).count() == 0


def test_disclosing_terms(spark):
    secret = [f"word{i} says Quixotl writes to ann@x.org from {i} places" for i in range(5)]
    plain = [f"some says writes other thing number {i} to from places" for i in range(40)]
    alone = ["Quixotl says nothing"]
    copies = ["zebulon met bob@y.org"] * 6  # equal contexts support nothing
    texts = secret + plain + copies
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    for i, text in enumerate(texts):
        terms = [tuple(map(int, s.split(":")[1:])) for s in spans[i].split(",") if s.startswith("term")]
        assert [text[a:b] for a, b in terms] == (["Quixotl"] if "ann@" in text else []), text
    redacted = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert redacted[0] == "word0 says [TERM] writes to [EMAIL] from 0 places" and redacted[7] == texts[7] and redacted[46] == "zebulon met [EMAIL]"
    # a term that stands in other texts as well tells less
    docs = spark.createDataFrame(list(enumerate(texts + alone * 3 + [f"Quixotl {i}" for i in range(40)])), "doc_id long, text string")
    assert not any("term" in r.spans for r in pii.report(docs).collect())


def test_terms_of_rare_values(spark):
    secret = ["a note by Quixotl (ann@x.org) on rivers", "later Quixotl moved, ask ann@x.org for more", "once only Zebulon wrote bob@y.org here"]
    long = "9" * 150 + "x"  # the context is eight words however long they are
    secret += [f"Umbriel {long} {long} cat@z.org first", f"then Umbriel {long}y {long}z cat@z.org second"]
    secret += [f"dan@w.org {'q' * 250} Ariel one", f"two {'r' * 5000} Ariel {'s' * 250} dan@w.org"]
    secret += ["eve@v.org met Tethys, eve@v.org and Tethys again"]  # what one text shows twice
    texts = secret + [f"some other thing number {i} on rivers for more" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    found = [sorted({texts[i][a:b] for a, b in (map(int, s.split(":")[1:]) for s in spans[i].split(",") if s.startswith("term"))}) for i in range(len(texts))]
    assert found == [["Quixotl"]] * 2 + [[]] + [["Umbriel"]] * 2 + [["Ariel"]] * 2 + [[]] * 41


# -- fingerprints -------------------------------------------------------------


def test_fingerprints():
    long = " ".join(f"w{i}" for i in range(3000))
    half = " ".join(f"w{i}" for i in range(1500))
    a, b, c, d, e = sketch.fingerprints(pa.array([long, half, "one two", None, long]))
    assert (a == e).all() and len(c) == 1 and len(d) == 0
    assert abs(sketch.resemblance(a, b) - 0.5) < 0.15 and abs(sketch.containment(b, a) - 1) < 0.3 and abs(sketch.distinct(a) / 2996 - 1) < 0.3
    assert sketch.resemblance(d, d) == 1.0 and sketch.resemblance(c, d) == 0.0 and sketch.resemblance(a, e) == 1.0
    assert (sketch.merge(a, b) == a).all()
    assert (sketch.from_text(sketch.to_text(a)) == a).all()


def test_fingerprints_of_parts_merge(spark):
    parts = [" ".join(f"w{i}" for i in range(200 * j, 200 * j + 204)) for j in range(6)]
    docs = spark.createDataFrame([(i % 2, t) for i, t in enumerate(parts)], "doc_id long, text string").repartition(4)
    rows = sketch.fingerprint(docs)
    merged = {r.doc_id: sketch.from_text(r.fingerprint) for r in sketch.merge_by(rows.select("doc_id", "fingerprint"), "doc_id").collect()}
    for k in (0, 1):
        own = sketch.fingerprints(pa.array(parts[k::2]))
        assert (merged[k] == sketch.merge(sketch.merge(own[0], own[1]), own[2])).all()


def test_edited_texts(spark):
    texts = [(5, "a b c d e f"), (1, None), (9, "é" * 7), (3, ""), (7, "word " * 5000), (None, "first of all"), (20, "x y z")]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, range int").repartition(3)
    found = {r.doc_id: r for r in sketch.edited(docs).collect()}
    ordered = sorted(texts, key=lambda t: (t[0] is not None, t[0]))
    assert len(found) == len(texts)
    for i, (key, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        assert found[key].n_chars == n and found[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = sketch.fingerprints(pa.array([text, edited, after]))
        assert found[key].near_edited == sketch.resemblance(a, b) and found[key].near_next == sketch.resemblance(a, c)
        assert found[key].fingerprint == sketch.to_text(a) and found[key].edited_fingerprint == sketch.to_text(b)
    assert sketch.edited(docs.limit(0)).count() == 0
    assert sketch.edited(docs.where("doc_id = 5")).first().near_next == 1.0


# -- language model -----------------------------------------------------------


def test_filter_gives_back_levels():
    hashes = bloomlm.mix(np.arange(3000, dtype=np.uint64))
    levels = np.arange(3000) % 5
    there = levels > 0
    model = bloomlm.filled(hashes[there], 2 ** levels[there] // 2, bloomlm.BITS)
    assert (model.level(hashes) == levels).mean() > 0.97 and (model.level(hashes) >= levels).all()
    assert bloomlm.filled(hashes[:0], levels[:0], bloomlm.BITS).level(hashes).sum() == 0


def test_language_model(spark):
    texts = ["the cat sat", "the cat ran", "THE dog\tsat", None, "", "unseen words only", "the " * 3000, "é ß\x1c", "the cat sat"]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double").repartition(2)
    learned = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    from lodestead.llm.frames import bucket

    found = {r.doc_id: r for r in bloomlm.score(docs, bucket(docs.doc_id, 7) == 2).collect()}
    counts = Counter(w for i, t in enumerate(texts) if learned(i) for w in [*blank_words(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, text in enumerate(texts):
        tokens = [*blank_words(text), None]
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learned(i), len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), rel_tol=1e-9, abs_tol=1e-9)
        assert r.score <= 0
    assert found[0].score > found[5].score
    assert bloomlm.score(docs.limit(0), bucket(docs.doc_id, 7) == 2).count() == 0
    nothing = bloomlm.score(docs, docs.doc_id.isNotNull()).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and r.score == 0 for r in nothing)


def mixed_score(texts, learned, least, share=bloomlm.SHARE):
    """The score of every text by exact counts, each replaced by the mean of those with its binary logarithm."""
    tokens = [[*blank_words(t), None] for t in texts]
    words = Counter(w for t, use in zip(tokens, learned) if use for w in t)
    pairs = Counter(p for t, use in zip(tokens, learned) if use for p in zip([0, *t], t))
    norm = sum(words.values()) + len(words) + 1

    def rough(n):
        return 1.5 * 2 ** (n.bit_length() - 1) - 0.5 if n else 0.0

    out = []
    for t in tokens:
        total = 0.0
        for before, word in zip([0, *t], t):
            single, context = (rough(words[word]) + 1) / norm, rough(words[before if before != 0 else None])
            n = pairs[before, word]
            pair = min(rough(n if n >= least else 0), context)
            total += math.log10(share * pair / max(1, context) + (1 - share) * single if context else single)
        out.append(total)
    return out


def test_language_model_score_against_exact_counts(spark):
    from lodestead.llm.frames import bucket

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 80) % 3000) for _ in range(60)] + [None, "", "once in all texts", "never seen", "w1 w1 " * 3000, "w1", "w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    held = bucket(docs.doc_id, 7) == 2
    learned = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    for least in (1, 2):
        # bits enough for a wrong yes of the filter to be unlikely in a small corpus
        found = {r.doc_id: r.score for r in bloomlm.score(docs, held, least=least, bits=200).collect()}
        assert len(found) == len(texts)
        for i, wanted in enumerate(mixed_score(texts, learned, least)):
            assert math.isclose(found[i], wanted, rel_tol=1e-9), (least, i)
    # with the bits of the query a wrong yes moves few scores, and those little
    rough = {r.doc_id: r.score for r in bloomlm.score(docs, held).collect()}
    off = [abs(rough[i] - wanted) / abs(wanted) for i, wanted in enumerate(mixed_score(texts, learned, 2))]
    assert np.median(off) < 0.01 and max(off) < 0.2
    assert bloomlm.score(docs.limit(0), held, least=1).count() == 0


def test_model_beats_its_base_on_held_out_texts(spark):
    rows = [r for r in QUERIES["op10_lm_scoring"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_registered_join_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op3_jaccard_join"](spark, SMALL).collect())) == sorted(classes(rows))
    texts = dict(rows)
    for r in QUERIES["op4_pii"](spark, SMALL).collect():
        assert r.base_sha256 == hashlib.sha256(base(texts[r.doc_id]).encode()).hexdigest()
    counted = defaultdict(int)
    for r in QUERIES["op5_fingerprints"](spark, SMALL).collect():
        assert r.n_chars == len(texts[r.doc_id] or "")
        counted[r.fingerprint] += 1
    assert sum(counted.values()) == len(rows)
