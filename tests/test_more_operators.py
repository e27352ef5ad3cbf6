"""Pre-nets, subsets of chains, joined and replaced blocks, minimizers and Mash distances against plain Python."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from sparkloom.operators import blocks, chains, graphs, intervals, kmers


def test_pre_net_against_bitmaps(spark):
    r, rows = random.Random(4), []
    for i in range(60):
        t, q, b = r.randint(0, 150), r.randint(0, 150), []
        for _ in range(r.randint(1, 3)):
            n = r.randint(1, 20)
            b.append((t, q, n))
            t, q = t + n + r.randint(0, 5), q + n + r.randint(0, 5)
        rows.append((i, float(r.randint(1, 30)), f"t{r.randint(0, 2)}", 300, f"q{r.randint(0, 2)}" + ("_hap" if i % 20 == 7 else ""), 300, b))
    maps, want = {}, []
    for i, score, t, _, q, _, b in sorted(rows, key=lambda x: (-x[1], x[0])):
        if "_hap" in q:
            continue
        on_t, on_q = maps.setdefault(t, set()), maps.setdefault(q, set())
        if any(not (set(range(x, x + n)) <= on_t and set(range(y, y + n)) <= on_q) for x, y, n in b):
            want.append(i)
            for x, y, n in b:
                on_t |= set(range(max(0, x - 1), min(300, x + n + 1)))
                on_q |= set(range(max(0, y - 1), min(300, y + n + 1)))
    df = spark.createDataFrame(rows, "id long, score double, t_name string, t_size long, q_name string, q_size long, blocks array<struct<t:long,q:long,n:long>>")
    assert sorted(x.id for x in chains.pre_net(df).collect()) == sorted(want)
    assert chains.pre_net(df.limit(0)).count() == 0


def test_subset_of_a_chain(spark):
    b = spark.createDataFrame([(1, 10, 100, 20), (1, 40, 130, 10), (2, 0, 0, 5)], "id long, t long, q long, n long")
    spans = spark.createDataFrame([(1, 25, 45), (2, 5, 9)], "id long, s long, e long")
    assert [tuple(x) for x in chains.subset(b, spans, ["id"]).collect()] == [(1, 25, 45, 115, 135, 2, 10)]


def test_joined_blocks(spark):
    df = spark.createDataFrame([("b1", 0, "t", "AC"), ("b1", 1, "x", "AG"), ("b2", 0, "t", "AC"), ("b2", 1, "y", "AT"), ("b3", 0, "t", "GG")], "block_id string, idx int, name string, seq string")
    heads = spark.createDataFrame([("b1", "r1"), ("b2", "r1"), ("b3", "r2")], "block_id string, target string")
    got = sorted((x.target, x.place, x.block_id, x.name) for x in blocks.joined(df, heads).collect())
    assert got == [("r1", 1, "b1", "t"), ("r1", 2, "b1", "x"), ("r1", 3, "b2", "y"), ("r2", 1, "b3", "t")]


def test_replaced_headers(spark):
    rows = [("one", 0, "a"), ("one", 1, "b"), ("two", 0, "a"), ("two", 1, "c"), ("twice", 0, "a"), ("twice", 1, "a"), ("none", 0, "z"), ("drop", 0, "d")]
    m = spark.createDataFrame([("a", ["x", "y"]), ("c", ["w"]), ("d", [])], "old string, news array<string>")
    got = sorted((x.block_id, x.copy, x.idx, x.name) for x in blocks.replaced(spark.createDataFrame(rows, "block_id string, idx int, name string"), m).collect())
    assert got == [("none", 0, 0, "z"), ("one", 0, 0, "x"), ("one", 0, 1, "b"), ("one", 1, 0, "y"), ("one", 1, 1, "b"), ("twice", 0, 0, "a"), ("twice", 0, 1, "a"), ("two", 0, 0, "a"), ("two", 0, 1, "c")]


@pytest.mark.parametrize("w", [1, 2, 5, 10])
def test_jumping_minimizers(w):
    r = random.Random(w)
    for _ in range(50):
        h = np.array([r.randint(0, 6) for _ in range(r.randint(0, 40))], np.uint64)
        want, at = [], 0
        if len(h) >= w:
            while at < len(h) - w:
                at = min(range(at, at + w), key=lambda i: (h[i], i))
                want.append(at)
                at += 1
            last = min(range(len(h) - w, len(h)), key=lambda i: (h[i], i))
            if not want or want[-1] != last:
                want.append(last)
        assert kmers.jumping_places(h, w) == want


def test_window_hashes_follow_bytes():
    raw = np.frombuffer(b"ACGTACGTACGTNNACGTACGTACGT", np.uint8)
    for k in (1, 3, 8, 9, 12):
        h = kmers._window_hashes(raw, k)
        seen = {}
        for i in range(len(h)):
            assert seen.setdefault(raw[i : i + k].tobytes(), h[i]) == h[i]
        assert len(set(seen.values())) == len(seen)


def test_mash(spark):
    a, b = list(range(0, 40, 2)), list(range(0, 60, 3))
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b] + [("c", 1001)], "name string, h long")
    (row,) = kmers.mash(df, 21, 20).collect()
    least = sorted(set(a) | set(b))[:20]
    shared = len(set(least) & set(a) & set(b))
    j = shared / 20
    assert (row.n1, row.n2, row.shared, row.size) == ("a", "b", shared, 20)
    assert row.mash == round(-math.log(2 * j / (1 + j)) / 21, 4)


LAV = """#:lav
d {
  "lastz some parameters"
}
s {
  "/data/one.fa" 1 1000 0 1
  "two.2bit-" 1 400 1 1
}
h {
   ">chrA.fa"
   ">chrB (reverse complement)"
}
a {
  s 900
  b 11 21
  e 60 75
  l 11 21 30 40 90
  l 33 41 40 48 75
  l 41 56 60 75 100
}
a {
  s 1
  l 5 9 9 8 50
}
m {
  n 0
}
"""


def test_lav(spark, tmp_path):
    from sparkloom.sources import lav

    (tmp_path / "x.lav").write_text(LAV)
    (row,) = lav.read(spark, f"{tmp_path}/x.lav").collect()
    assert (row.match, row.mismatch, row.strand) == (18 + 6 + 20, 2 + 2, "-")
    assert (row.q_name, row.q_size, row.q_start, row.q_end) == ("chrB", 400, 400 - 75, 400 - 20)
    assert (row.t_name, row.t_size, row.t_start, row.t_end) == ("chrA", 1000, 10, 60)
    assert (row.block_sizes, row.q_starts, row.t_starts) == ([20, 8, 20], [20, 40, 55], [10, 32, 40])
    assert (row.q_num_insert, row.q_base_insert, row.t_num_insert, row.t_base_insert) == (1, 7, 1, 2)
    with pytest.raises(ValueError):
        list(lav.records("a {\n  l 1 1 5 5 90\n}\n"))


def test_slices_against_columns(spark):
    r, rows, want = random.Random(6), [], []
    spans = [("c", 3, 8), ("c", 12, 12), ("c", 15, 40)]
    for b in range(40):
        width, entries = r.randint(5, 30), []
        for i in range(3):
            seq = "".join(r.choice("ACGTACGTACGT-") for _ in range(width))
            entries.append((f"b{b}", i, f"sp{i}", "c" if i == 0 else "x", r.choice("+-"), r.randint(1, 12), seq))
        if not entries[0][6].strip("-"):
            continue
        rows += entries
        at = {}  # place on the target -> column
        _, _, _, _, strand, s, seq = entries[0]
        cols = [i for i, x in enumerate(seq) if x != "-"]
        for k, c in enumerate(cols if strand == "+" else cols[::-1]):
            at[s + k] = c
        gap = [any(e[6][c] == "-" for e in entries) for c in range(width)]
        for _, lo, hi in spans:
            lo, hi = max(lo, s), min(hi, s + len(cols) - 1)
            if lo > hi:
                continue
            x, y = sorted((at[lo], at[hi]))
            while x <= y and gap[x]:
                x += 1
            while y >= x and gap[y]:
                y -= 1
            if x > y:
                continue
            for blk, i, name, ch, st, start, q in entries:
                own = [c for c, z in enumerate(q) if z != "-"]
                places = {c: start + (k if st == "+" else len(own) - 1 - k) for k, c in enumerate(own)}
                a, z = sorted((places[x], places[y]))
                want.append((blk, lo, i, name, ch, st, a, z, q[x : y + 1]))
    df = spark.createDataFrame(rows, "block_id string, idx int, name string, chr string, strand string, s long, seq string")
    got = blocks.sliced(df, spark.createDataFrame(spans, "chr string, s long, e long"))
    assert sorted(tuple(x) for x in got.collect()) == sorted(want) and len(want) > 100


def test_block_files(spark):
    df = spark.createDataFrame([("1", 1, "b", "c9", "AG"), ("1", 0, "a", "c1", "AC"), ("2", 0, "a", "c2", "TT")], "block_id string, idx int, name string, chr string, seq string")
    assert sorted(tuple(x) for x in blocks.as_files(df).collect()) == [("1", "a.c1.fas", ">a\nAC\n>b\nAG\n"), ("2", "a.c2.fas", ">a\nTT\n")]
    assert sorted(x.file for x in blocks.as_files(df, by_block=True).collect()) == ["1.fas", "2.fas"]


def _rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def _own_kmers(text, k):
    """Places and canonical k-mers of ACGT alone."""
    return [(i, min(text[i : i + k], _rc(text[i : i + k]))) for i in range(len(text) - k + 1) if set(text[i : i + k]) <= set("ACGT")]


def test_keyed_kmers_of_a_set(spark, monkeypatch):
    """Only k-mers of a library leave their task, in pieces smaller than a text too."""
    monkeypatch.setattr(kmers, "PIECE", 64)
    r = random.Random(3)
    rows = [("a", "".join(r.choice("ACGT") for _ in range(300)) + "N" + "GATTACA" * 9), ("b", "ACG"), ("c", None), ("a", "TTGACCATTGAACCGTAC" * 4)]
    df, lib = spark.createDataFrame(rows, "name string, seq string"), spark.createDataFrame([("l", rows[0][1][100:140])], "name string, seq string")
    number = lambda x: sum("ACGT".index(c) << 2 * i for i, c in enumerate(reversed(x)))
    want = sorted((n, i, number(x)) for n, t in rows for i, x in _own_kmers(t or "", 20))
    assert sorted(tuple(x) for x in kmers.keyed(df, 20).collect()) == want
    table = kmers.bit_table(kmers.keyed(lib, 20))
    got = sorted(tuple(x) for x in kmers.keyed(df, 20, among=table).collect())
    own = {number(x) for _, x in _own_kmers(rows[0][1][100:140], 20)}
    assert {x for x in want if x[2] in own} <= set(got) and len(got) < 40 and len(table) == 1 << 21


def test_pre_net_of_equal_ids(spark):
    """A covered chain goes, though another one with its id stays."""
    rows = [(7, 9.0, "t0", 300, "q0", 300, [(10, 10, 50)]), (7, 5.0, "t0", 300, "q0", 300, [(20, 20, 20)]), (8, 4.0, "t0", 300, "q1", 300, [(20, 20, 20)])]
    df = spark.createDataFrame(rows, "id long, score double, t_name string, t_size long, q_name string, q_size long, blocks array<struct<t:long,q:long,n:long>>")
    assert sorted((x.id, x.score) for x in chains.pre_net(df).collect()) == [(7, 9.0), (8, 4.0)]


def _hash(x):
    return int(hashlib.md5(x.encode()).hexdigest()[:15], 16)


def test_sketches_of_packed_kmers(spark, monkeypatch):
    """Against md5 of strings; texts longer than a piece, repeated names, runs of one k-mer."""
    monkeypatch.setattr(kmers, "PIECE", 64)
    r = random.Random(5)
    rows = [("a", "".join(r.choice("ACGT") for _ in range(400))), ("b", "A" * 200 + "CCGT"), ("c", None), ("a", "GATTACAT" * 6), ("d", "AC")]
    want = {}
    for n, t in rows:
        want.setdefault(n, set()).update(_hash(x) for _, x in _own_kmers(t or "", 21))
    got = {x.name: x.hs for x in kmers.sketches(spark.createDataFrame(rows, "name string, seq string"), 21, 12).collect()}
    assert got == {n: sorted(h)[:12] for n, h in want.items() if h}
    below = 1 << 58
    got = sorted(tuple(x) for x in kmers.hashed(spark.createDataFrame(rows, "name string, seq string"), 21, below).collect())
    assert got == sorted((n, x) for n, h in want.items() for x in h if x < below)


def test_runs_of_shared_kmers(spark, monkeypatch):
    """Positions under k-mers that two names hold; a name that comes twice is one name."""
    monkeypatch.setattr(kmers, "PIECE", 32)
    r = random.Random(8)
    rows = [(n, "".join(r.choice("ACGTN"[: 4 + (i % 9 == 0)]) for i in range(90))) for n in "abcad"] + [("e", None), ("f", "AC"), ("g", "ACGT" * 30)]
    holders = {}
    for n, t in rows:
        for i in range(len(t or "") - 3):
            holders.setdefault(t[i : i + 4], set()).add(n)
    want = {(n, i + 1 + j) for n, t in rows for i in range(len(t or "") - 3) if set(t[i : i + 4]) <= set("ACGT") and len(holders[t[i : i + 4]]) > 1 for j in range(4)}
    got = kmers.shared_runs(spark.createDataFrame(rows, "name string, seq string").repartition(3), 4).collect()
    assert {(x.name, i) for x in got for i in range(x.s, x.e + 1)} == want
    assert kmers.shared_runs(spark.createDataFrame([("a", "ACGTACGT"), ("a", "ACGTACGT")], "name string, seq string"), 4).count() == 0


def test_mash_of_ranks(spark):
    """Against merged sketches, short and equal ones too; no join carries a sketch for each pair."""
    r = random.Random(6)
    own = {f"n{i:02}": sorted(r.sample(range(40), r.choice([3, 8, 10, 10]))) for i in range(20)}
    own |= {"z1": own["n03"], "z2": own["n03"]}
    df = spark.createDataFrame([(n, h) for n, hs in own.items() for h in hs], "name string, h long")
    want = set()
    for a in own:
        for b in own:
            both = set(own[a]) & set(own[b])
            if a < b and both:
                fewest = sorted(set(own[a]) | set(own[b]))[:10]
                want.add((a, b, len(both & set(fewest)), len(fewest)))
    out = kmers.mash(df, 21, 10)
    assert sorted((x.n1, x.n2, x.shared, x.size) for x in out.collect()) == sorted(want)
    assert "array_intersect" not in out._jdf.queryExecution().toString()


def test_cover_of_many_sets(spark):
    """Against a plain loop, over parts that share nothing; no job for each set."""
    r = random.Random(9)
    rows = sorted({(f"s{i}", i, (i % 3) * 100 + r.randint(0, 30)) for i in range(24) for _ in range(r.randint(1, 12))})
    left, want = {}, []
    for s, seq, item in rows:
        left.setdefault((s, seq), set()).add(item)
    while any(left.values()):
        best = max(left, key=lambda x: (len(left[x]), x[1]))
        gone = set(left[best])
        want.append((len(want) + 1, best[0], len(gone)))
        left = {x: items - gone for x, items in left.items()}
    out = graphs.greedy_cover(spark.createDataFrame(rows, "set string, seq long, item long"))
    assert [tuple(x) for x in out.orderBy("step").collect()] == want
    assert "LocalTableScan" not in out._jdf.queryExecution().executedPlan().toString() and out.columns == ["step", "set", "gain"]


@pytest.mark.parametrize("k, least, gap, size", [(17, 3, 10, 400), (7, 2, 0, 1 << 23), (31, 2, 3, 90)])
def test_repeats_as_runs(spark, monkeypatch, k, least, gap, size):
    """Every position under a k-mer that occurs often, by plain counting; runs come joined, across chunks of texts too."""
    r = random.Random(k)
    common = ["".join(r.choice("ACGT") for _ in range(60)) for _ in range(3)]
    turned = [x[::-1].translate(str.maketrans("ACGT", "TGCA")) for x in common]
    texts = ["".join(r.choice([*common, *turned, "N", "", "é", "ACGTTGCAAT" * 3, "A"]) + "".join(r.choice("ACGT") for _ in range(r.randrange(30))) for _ in range(r.randrange(12))) for _ in range(40)]
    canonical = lambda x: min(x, x[::-1].translate(str.maketrans("ACGT", "TGCA")))
    places = [(i, o, canonical(t[o : o + k])) for i, t in enumerate(texts) for o in range(len(t) - k + 1) if set(t[o : o + k]) <= set("ACGT")]
    many = Counter(x for _, _, x in places)
    want = []
    for i, o, x in places:
        if many[x] >= least:
            if want and want[-1][0] == i and o <= want[-1][2] + gap:
                want[-1][2] = o + k
            else:
                want.append([i, o + 1, o + k])
    monkeypatch.setattr(kmers, "CHUNK", size)
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate([*texts, None])], "name string, seq string").repartition(3)
    got = kmers.repeats(df, k, least, gap)
    if size > 1000:
        assert sorted([int(x.name), x.s, x.e] for x in got.collect()) == want
    joined = intervals.islands(got, ["name"], gap + 1)
    assert sorted([int(x.name), x.s, x.e] for x in joined.collect()) == want


def test_hashes_of_a_passage_are_joined_once(spark):
    """Names that share a passage make one row each to join for all of its hashes; k-mers are characters, and records of one name are one set."""
    r = random.Random(3)
    passage = "".join(r.choice("ACGT né") for _ in range(300))
    texts = [(f"n{i % 29}", "".join(r.choice("ACGTé") for _ in range(40)) + (passage if i % 3 else "") + "".join(r.choice("AC") for _ in range(9))) for i in range(30)] + [("short", "ACG"), ("none", None), ("copy", passage), ("twin", passage)]
    plain = "".join(r.choice("ACGT") for _ in range(50))
    texts += [("ascii", plain), ("latin", "é" + plain), ("wide", plain + "Жé" + plain[:30]), ("far", "\U0001f600" + plain[:30] + "Жé" + plain)]
    df = spark.createDataFrame(texts, "name string, seq string")
    sets = {}
    for n, t in texts:
        sets.setdefault(n, set()).update((t or "")[i : i + 21] for i in range(len(t or "") - 20))
    want = {(a, b): (len(sets[a] & sets[b]), round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 4)) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    hashes = kmers.minimizers(df, 21)
    assert hashes.count() == sum(map(len, sets.values()))
    pairs = kmers.similarity(hashes, 21)
    assert {(x.n1, x.n2): (x.shared, x.jaccard) for x in pairs.collect()} == want
    joined = [int(m) for m in made_by_joins(pairs)]
    assert max(joined) < sum(n for n, _ in want.values()) / 5, joined


def made_by_joins(df):
    """Rows that the plan's joins made, once it has run."""
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def visit(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return visit(node.executedPlan())
        if "QueryStage" in name:
            return visit(node.plan())
        if "Join" in name:
            out.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))

    visit(plan)
    return out
