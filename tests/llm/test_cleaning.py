"""Line deduplication, whitening and conversation repair against brute force."""

import hashlib
import heapq
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from lodestead.llm import linededup, turns, whitening
from lodestead.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"
BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# -- lines --------------------------------------------------------------------


def deduplicated(rows, least=40, documents=5):
    before = lambda i: (i is not None, i or 0)
    key = lambda line: lower(line.strip(BLANKS))
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(held[key(x)]) < documents or i == max(held[key(x)], key=before)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_line_dedup(spark):
    common, edge, short = "This Line stands in very many documents, É and all", "é" * 40, "x" * 39
    rows = [(i, f"own line {i}\n{common}\n{'TAIL ' * 10}{i}") for i in range(20)]
    rows += [(100 + i, f"\t {lower(common)}\x0b\n\n{edge}\r\n{short}\n{common}") for i in range(6)]
    rows += [(200 + i, "in four documents only, which is one less than five") for i in range(4)] + [(200, "in four documents only, which is one less than five")] * 3
    rows += [(300, None), (301, ""), (302, "\n"), (303, "\n\n"), (304, common), (304, common), (304, "another text of that id"), (None, common), (None, None), (None, f"{edge}\nz")]
    rows += [(400, "\n".join([common] * 2000 + [f"line {i} of a long text, which is in no other one" for i in range(2000)]))]
    rows += [(500 + i, "only those without an id and four others hold this line") for i in range(4)] + [(None, "only those without an id and four others hold this line")] * 2
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, print string, at int").repartition(5)
    found = [(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in linededup.deduplicate(docs).collect()]
    assert in_order(found) == in_order(deduplicated(rows))
    assert linededup.deduplicate(docs.limit(0)).count() == 0
    nothing = [(r.doc_id, r.n_dropped) for r in linededup.deduplicate(docs.where("doc_id IS NULL OR doc_id > 299 AND doc_id < 304")).collect()]
    assert all(n == 0 for _, n in nothing)


@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
def test_line_dedup_twin(spark, folder):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    columns = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    found = sorted(map(tuple, QUERIES["op11_line_dedup"](spark, folder).select(*columns).collect()))
    assert found == sorted(duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES['op11_line_dedup']})").fetchall())
    assert sum(r[2] for r in found) > 0


def test_line_dedup_is_linear_in_a_text(spark):
    """The text is put together from positions, not by looking every line up among the dropped ones."""
    import time

    def seconds(n):
        text = "\n".join(f"{'common ' * 6}{i}" for i in range(n))
        docs = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string")
        began = time.perf_counter()
        assert {r.n_dropped for r in linededup.deduplicate(docs).collect()} == {0, n}
        return time.perf_counter() - began

    seconds(100)
    assert seconds(20_000) < 15 * max(seconds(2_000), 0.5)


# -- whitening ----------------------------------------------------------------


def whitened(vectors, k=16):
    """By a singular value decomposition of all centred rows."""
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    a = (n * fit - sums) / n
    _, s, v = np.linalg.svd(a, full_matrices=False)
    e, v = s**2 / n, v.T
    out = ((n * x - sums) / n) @ v[:, :k] / np.sqrt(e[:k])
    return n, ((n * x - sums) ** 2).sum(axis=1), out, e[:k] / e.sum(), e


def compare(rows, ids, vectors, k):
    n, far, out, share, e = whitened(vectors, k)
    place = {i: j for j, i in enumerate(ids)}
    by = defaultdict(dict)
    for r in rows:
        j = place[r.vec_id]
        by[r.component][j] = r.whitened
        assert r.n == n and r.deviation == far[j] and abs(r.explained - share[r.component - 1]) <= 1e-9 * share[r.component - 1]
        assert r.identity_error <= 1e-9
    assert sorted(by) == list(range(1, k + 1))
    for c, own in by.items():
        found = np.array([own[j] for j in range(len(ids))])
        sign = np.sign(found @ out[:, c - 1])
        assert np.abs(sign * found - out[:, c - 1]).max() < 1e-6, c


def test_whitening(spark):
    rng = np.random.default_rng(8)
    turned, _ = np.linalg.qr(rng.normal(size=(24, 24)))
    vectors = (rng.normal(size=(500, 24)) * 2.0 ** -np.arange(24) * 5000) @ turned + rng.normal(size=24) * 300
    vectors = [v.tolist() for v in vectors]
    rows = [(i, v, "x") for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[7], "x") for i in range(300)]  # one vector of very many rows
    bad = [(2000, None), (2001, []), (2002, [None] * 24), (2003, [1.0] * 23 + [float("nan")]), (2004, [1.0] * 23 + [float("-inf")]), (2005, [1.0, 2.0]), (2006, [1e300] * 24)]
    frame = spark.createDataFrame(rows + [(*b, "x") for b in bad], "vec_id long, embedding array<double>, x string").repartition(7)
    found = whitening.whiten(frame).collect()
    compare(found, [r[0] for r in rows], [r[1] for r in rows], 16)
    assert whitening.whiten(frame.limit(0)).count() == 0
    assert whitening.whiten(frame.where("vec_id IN (7, 1000, 1001, 2000)")).count() == 0


def test_whitening_without_full_rank(spark):
    """Constant and dependent dimensions, and fewer vectors than dimensions, have fewer components."""
    rng = np.random.default_rng(9)
    low = rng.integers(-300, 300, (200, 3))
    vectors = [[*(x / 4).tolist(), float(x.sum()) / 4, 2.5, 0.0] for x in low]
    rows = list(enumerate(vectors)) + [(None, vectors[0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = whitening.whiten(frame).collect()
    assert {r.component for r in found} == {1, 2, 3} and sum(r.vec_id is None for r in found) == 3
    compare([r for r in found if r.vec_id is not None], range(200), vectors, 3)
    few = [(i, rng.normal(size=40).tolist()) for i in range(5)]
    found = whitening.whiten(spark.createDataFrame(few, "vec_id long, embedding array<double>")).collect()
    compare(found, range(5), [v for _, v in few], 4)


def test_whitening_keeps_whole_numbers_exact():
    x = np.array([[2**45, 3], [5, 2**40]], np.int64)
    n, sums = 10**9, [7 * 10**20, 3 * 10**9 + 1]
    found = whitening.numerators(x, n, sums)
    assert [[int(v) for v in row] for row in found] == [[n * int(v) - s for v, s in zip(row, sums)] for row in x.tolist()]
    assert whitening.deviations(x, n, sums) == [None, None]
    small = whitening.deviations(np.array([[1, 5]]), 3, [4, 9])
    assert small == [(3 - 4) ** 2 + (15 - 9) ** 2]


def test_registered_whitening(spark):
    table = spark.read.parquet(f"{MIDDLE}/embeddings.parquet").collect()
    found = QUERIES["op12_whitening"](spark, MIDDLE).collect()
    compare(found, [r.vec_id for r in table], [r.embedding for r in table], 16)


# -- conversations ------------------------------------------------------------


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def repaired(rows):
    """The cheapest edits by a search over (cost, letters so far), however long."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(BLANKS)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns_ = [t for t, _, _ in rows if t is not None]
    gaps = max(turns_) - min(turns_) + 1 - len(set(turns_)) if turns_ else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best, queue = set(), [(0, "", 0, "", ())]
    while True:
        cost, audit, i, state, out = heapq.heappop(queue)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in best:
            continue
        best.add((i, state))
        moves = []
        for role in ("user", "assistant"):
            if role[0] in after[state]:
                moves.append((3, "I", i, role[0], (role, "")))
        if i < len(rows):
            _, role, text = rows[i]
            moves.append((4, "D", i + 1, state, None))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                if role[:1] in after[state]:
                    moves.append((extra, "K", i + 1, role[:1], (role, text)))
                for other in ("user", "assistant"):
                    if other[0] in after[state]:
                        moves.append((3 + extra, "R", i + 1, other[0], (other, text)))
        for paid, letter, j, then, line in moves:
            heapq.heappush(queue, (cost + paid, audit + letter, j, then, out + ((line,) if line else ())))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


def reports(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    return [(conv, *repaired(damaged(own))) for conv, own in by.items()]


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def conversations():
    rng = np.random.default_rng(4)
    rows = []
    for conv in range(400):
        roles = rng.choice(["user", "assistant", "system", "tool", "", None, "User"], rng.integers(1, 9), p=[0.35, 0.3, 0.15, 0.05, 0.05, 0.05, 0.05])
        for i, role in enumerate(roles):
            turn = None if rng.random() < 0.05 else int(i + rng.integers(0, 2))
            text = rng.choice(["Hello.", "well", " \t", "", "Yes! \n", "a?", "text\n", None, "é…", "one. two"])
            rows.append((conv, turn, None if role is None else str(role), None if text is None else str(text)))
    rows += [(900, 0, "system", "Be brief."), (901, 0, "system", "Be."), (901, 1, "assistant", "Yes."), (None, 0, "user", "Who?"), (None, None, "assistant", "Me."), (902, None, None, None)]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "All of this goes.")]


def test_turn_repair(spark, monkeypatch):
    rows = conversations()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, copy int, fault string").repartition(6)
    expected = in_order(reports(rows))
    assert in_order(map(tuple, turns.report(turns.damage(frame)).select(*COLUMNS).collect())) == expected
    gone = [r for r in expected if r[7] == ""]
    assert any(r[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in gone)
    assert turns.report(turns.damage(frame.limit(0))).count() == 0
    # state goes from batch to batch
    monkeypatch.setattr("lodestead.llm.frames.BATCH_ROWS", 3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert in_order(map(tuple, turns.report(turns.damage(frame)).select(*COLUMNS).collect())) == expected
        edits = turns.repair(turns.damage(frame)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    by = defaultdict(list)
    for r in edits:
        by[r.conv_id].append(r)
    for r in expected:
        own = sorted(by[r[0]], key=lambda x: x.position)
        assert "".join(x.edit for x in own) == r[7]
        kept = [f"{x.role}:{x.text}" for x in own if x.edit != "D"]
        assert hashlib.sha256("\n".join(kept).encode()).hexdigest() == r[8]


def test_turn_repair_of_a_giant_conversation(spark):
    """A conversation of very many batches has the edits of its parts, and rows are dealt out once."""
    rng = np.random.default_rng(6)
    rows = [(1, i, str(rng.choice(["user", "assistant"])), f"text {i}.") for i in range(30_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = turns.report(frame).collect()
    assert len(found) == 1 and found[0].gaps == 0
    short = turns.report(frame.where("turn < 300")).first()
    assert tuple(short)[1:] == repaired([r[1:] for r in rows[:300]])
    plan = frame.sparkSession._jvm.PythonSQLUtils.explainString(turns.report(frame)._jdf.queryExecution(), "simple")
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
def test_registered_turn_repair(spark, folder):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    found = QUERIES["op13_turn_repair"](spark, folder).select(*COLUMNS).collect()
    assert in_order(map(tuple, found)) == in_order(reports(rows))
