"""Literals and edge cases of the operators."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import ranges, seqs
from sparkloom.operators import alignments, blocks, chains, graphs, intervals, kmers, sequences


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def spans(spark, *items):
    return spark.createDataFrame(list(items), "chr string, s long, e long")


def test_cover_from_text_lines(spark):
    lines = spark.createDataFrame([("chr1:1-10",), ("chr1:5-15",), ("chr2(+):100-200",), ("bad line",), ("chr1:20-25",), ("chr2:150-160",)], "line string")
    r = lines.select(ranges.parse(F.col("line")).alias("r")).filter("r.valid").select("r.chr", F.col("r.s").cast("long").alias("s"), F.col("r.e").cast("long").alias("e"))
    assert rows(intervals.islands(r, ["chr"])) == [("chr1", 1, 15), ("chr1", 20, 25), ("chr2", 100, 200)]


@pytest.mark.parametrize("text, want", [("I:7", ("I", "", 7, 7, True)), ("a.I(-):3_9", ("I", "-", 3, 9, True)), ("I:5-0", ("I", "", 5, 5, True)), ("I:9-3", ("I", "", 9, 3, False)), ("I:99999999999", ("I", "", None, None, False)), ("word", ("word", "", None, None, False))])
def test_range_grammar(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(ranges.parse(F.col("t")).alias("r")).first().r
    assert (r.chr, r.strand, r.s, r.e, r.valid) == want


@pytest.mark.parametrize("op, mode, n, strand, want", [("flank", "5p", 30, "-", (201, 230)), ("flank", "5p", 30, "+", (70, 99)), ("trim", "5p", 30, "-", (100, 170)), ("trim", "both", 60, "+", (None, None)), ("excise", "both", 200, "+", (None, None)), ("flank", "3p", 0, "+", (None, None)), ("pad", "both", 200, "+", (1, 400))])
def test_span_ops(spark, op, mode, n, strand, want):
    s, e = ranges.span(F.col("s"), F.col("e"), F.col("strand"), op, mode, n)
    assert tuple(spark.createDataFrame([(100, 200, strand)], "s int, e int, strand string").select(s, e).first()) == want


def test_islands_do_not_depend_on_tiles(spark):
    df = spans(spark, ("a", 1, 5), ("a", 6, 30), ("a", 32, 40), ("a", 100, 101), ("b", 7, 3), ("a", 2, 3))
    want = [("a", 1, 30), ("a", 32, 40), ("a", 100, 101)]
    assert rows(intervals.islands(df, ["chr"], tile=4)) == rows(intervals.islands(df, ["chr"])) == sorted(want)
    assert rows(intervals.depth_segments(df, ["chr"], tile=4)) == rows(intervals.depth_segments(df, ["chr"]))


def test_empty_tables(spark):
    none = spans(spark)
    assert rows(intervals.islands(none, ["chr"])) == []
    assert rows(intervals.span(none, ["chr"], "holes")) == []
    assert rows(intervals.overlap_count(none, none, "chr", [])) == []
    assert rows(graphs.components(spark.createDataFrame([], "a long, b long"))) == []


def test_paf_coverage_literal(spark):
    df = spark.createDataFrame([("t", 2, 12, ""), ("t", 7, 9, "")], "t_name string, t_start long, t_end long, cg string")
    assert rows(alignments.paf_coverage(df)) == [("t", 2, 7, 1), ("t", 7, 9, 2), ("t", 9, 12, 1)]


def test_n50_literal(spark):
    assert sequences.nx_stats(spark.createDataFrame([(50,), (30,), (20,)], "n int"), "n").first().nx == 50


def test_orf_literal(spark):
    coded = {v: k for k, v in seqs.CODONS.items()}
    dna = "".join(coded[a] for a in "MGGMGG*AGG")
    df = sequences.orfs(spark.createDataFrame([("x", dna)], "name string, seq string"))
    got = [(r.aa, r.s, r.e) for r in df.filter("strand = '+' AND frame = 0").orderBy("s").collect()]
    assert got == [("MGGMGG*", 1, 21), ("AGG", 22, 30)]


def test_base_counts(spark):
    df = spark.createDataFrame([("a", "ACGTNacgtnRY-"), ("b", "")], "name string, seq string")
    assert rows(sequences.base_counts(df)) == [("a", 12, 2, 2, 2, 2, 4), ("b", 0, 0, 0, 0, 0, 0), ("total", 12, 2, 2, 2, 2, 4)]


def test_masks(spark):
    df = spark.createDataFrame([("a", "ACgtNNac"), ("b", "nnnn")], "name string, seq string")
    assert rows(sequences.masked(df)) == [("a", 3, 8), ("b", 1, 4)]
    assert rows(sequences.masked(df, gaps_only=True)) == [("a", 5, 6), ("b", 1, 4)]
    soft = sequences.mask(spark.createDataFrame([("a", "ACGTACGT")], "name string, seq string"), spark.createDataFrame([("a", 2, 3), ("a", 7, 8)], "name string, s int, e int"))
    assert soft.first().seq == "AcgTACgt"
    with pytest.raises(Exception, match="beyond"):
        sequences.mask(df, spark.createDataFrame([("b", 2, 9)], "name string, s int, e int")).collect()


def test_kmers_are_canonical_and_skip_n(spark):
    df = spark.createDataFrame([("a", "ACGTNAC"), ("b", "GT")], "name string, seq string")
    assert rows(kmers.table(df, 2)) == [("AC", 4), ("CG", 1)]


def test_quality_histogram(spark):
    df = spark.createDataFrame([("r", "ACGTA", "IIII!")], "name string, seq string, qual string")
    assert rows(kmers.quality_histogram(df, 3, 20)) == [(1, 1), (2, 1)]


def test_similarity_of_copies(spark):
    h = spark.createDataFrame([(n, x) for n in "abc" for x in (1, 2, 3)] + [("d", 1), ("d", 9)], "name string, h long")
    got = {(r.n1, r.n2): (r.shared, r.jaccard) for r in kmers.similarity(h, 21).collect()}
    assert got == {("a", "b"): (3, 1.0), ("a", "c"): (3, 1.0), ("b", "c"): (3, 1.0), ("a", "d"): (1, 0.25), ("b", "d"): (1, 0.25), ("c", "d"): (1, 0.25)}


def test_block_statistics(spark):
    df = spark.createDataFrame([("b", 0, "x", "AC-TN"), ("b", 1, "y", "AGTTA")], "block_id string, idx int, name string, seq string")
    assert rows(blocks.stats(df)) == [("b", 5, 3, 1, 1, 1, 0.333)]
    assert rows(blocks.substitutions(df)) == [("b", 2, "C", "G", "CG", 1, "10")]


def test_swap_twice_is_the_same(spark):
    df = spark.createDataFrame([(9, 1, 0, 0, 0, 0, 0, 0, s, "q", 100, 10, 30, "t", 200, 40, 60, 2, [5, 10], [10, 20] if s == "+" else [70, 80], [40, 50]) for s in "+-"], ", ".join(f"{c} {'array<int>' if c in ('block_sizes', 'q_starts', 't_starts') else 'string' if c in ('strand', 'q_name', 't_name') else 'int'}" for c in alignments.PSL))
    twice = alignments.psl_swap(alignments.psl_swap(df))
    assert [r.asDict() for r in twice.select(*alignments.PSL).orderBy("strand").collect()] == [r.asDict() for r in df.orderBy("strand").collect()]


def test_components_and_cover(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (5, 5)], "a long, b long")
    assert rows(graphs.components(links)) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    m = spark.createDataFrame([("A", 0, 1), ("A", 0, 2), ("B", 1, 2), ("B", 1, 3), ("C", 2, 1)], "set string, seq long, item long")
    assert [tuple(r) for r in graphs.greedy_cover(m).collect()] == [(1, "B", 2), (2, "C", 1)]


@pytest.mark.parametrize("model", ["loose", "medium"])
def test_chains_cross_wide_gaps(spark, model):
    import random

    import numpy as np

    r, data, t, q = random.Random(9), [], 0, 0
    for _ in range(120):
        t, q = t + r.choice((50, 3000, 40_000, 110_000, 400_000)), q + r.choice((50, 3000, 40_000, 110_000))
        n = r.randint(20, 900)
        data.append((t, q, n, n * r.choice((3, 40, 100))))
        t, q = t + n, q + n
    a = np.array(data, np.int64)
    number = chains._chain_group(a[:, 1], a[:, 0], a[:, 2], a[:, 3], model)
    want = sorted((int(x[:, 0].min()), int((x[:, 0] + x[:, 2]).max()), len(x)) for k in set(number.tolist()) for x in [a[number == k]])
    df = spark.createDataFrame([("t", "q", "+", *x) for x in data], "t_name string, q_name string, strand string, t long, q long, n long, score long")
    got = rows(chains.chain_blocks(df, model).select("t_start", "t_end", "blocks"))
    assert got == want


def test_chains_of_many_small_pairs(spark):
    """Many pairs of a few blocks, and one with more rows than a batch holds: each as _chain_group has it alone, in seconds."""
    import time

    import numpy as np

    r = np.random.default_rng(4)
    n = 40_000
    data = [(f"t{g}", f"q{g % 7}", "+-"[g % 2], int(a), int(b), int(c), int(c) * 100) for g in r.integers(0, n // 3, n).tolist() for a, b, c in [r.integers([0, 0, 5], [3000, 3000, 60])]]
    data = sorted(set(data)) + [(None, "q", "+", 5, 5, 10, 1000), (None, "q", "+", 20, 20, 10, 1000)]
    want, by = [], {}
    for x in data:
        by.setdefault(x[:3], []).append(x[3:])
    for k, v in by.items():
        a = np.array(sorted(v, key=lambda x: (x[0], x[1], x[2])))
        number = chains._chain_group(a[:, 1], a[:, 0], a[:, 2], a[:, 3], "loose")
        want += [(str(k[0]), k[1], k[2], int(x[:, 0].min()), int((x[:, 0] + x[:, 2]).max()), len(x)) for i in set(number.tolist()) for x in [a[number == i]]]
    df = spark.createDataFrame(data, "t_name string, q_name string, strand string, t long, q long, n long, score long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "101")
    try:
        begun = time.time()
        got = [(str(x[0]), *x[1:]) for x in chains.chain_blocks(df).select("t_name", "q_name", "strand", "t_start", "t_end", "blocks").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert time.time() - begun < 60
    assert sorted(got) == sorted(want)


def test_net_of_many_targets(spark):
    """Nets of thousands of targets, in seconds; a null target is one of its own and no level leaks to the next."""
    import time

    data = [(None if i == 0 else f"t{i}", 0, 200, "a", "+", 9.0) for i in range(20_000)] + [(None, 10, 100, "b", "-", 12.0)]
    c = spark.createDataFrame(data, "t_name string, t_start long, t_end long, q_name string, strand string, score double").localCheckpoint()
    begun = time.time()
    got = [tuple(r) for r in chains.net(c).filter("t_name IS NULL OR s > 0 OR e < 200 OR level > 1").collect()]
    assert sorted(x[1:4] for x in got) == [(10, 100, "b"), (100, 200, "a")] and {x[6] for x in got} == {1}
    assert time.time() - begun < 20


def test_quality_histogram_counts_in_tasks(spark):
    """Good and other occurrences against plain Python; no row for each k-mer reaches a shuffle."""
    import random
    from collections import Counter

    r = random.Random(2)
    reads = [("".join(r.choice("ACGTN") for _ in range(n)), "".join(r.choice("!05I~") for _ in range(n))) for n in (0, 2, 3, 4, 40, 200)] + [(None, None)]
    high, low = Counter(), Counter()
    for s, q in reads:
        for i in range(len(s or "") - 2):
            x = s[i : i + 3]
            if "N" not in x:
                key = min(x, x[::-1].translate(str.maketrans("ACGT", "TGCA")))
                (high if all(ord(c) >= 48 for c in q[i : i + 3]) else low)[key] += 1
    want = Counter(min(high[x] or low[x], 127) for x in high | low)
    df = spark.createDataFrame([("r", *x) for x in reads], "name string, seq string, qual string")
    out = kmers.quality_histogram(df, 3, 15)
    assert {x.depth: x.kmers for x in out.collect()} == want
    assert "Generate" not in out._jdf.queryExecution().toString()


def test_orfs_of_odd_letters(spark):
    """Letters outside ASCII and ACGT give X, U is a letter of the other strand alone; frames are read without a plan for each codon."""
    df = sequences.orfs(spark.createDataFrame([("x", "éatgaaaTAAccU"), ("none", None), ("short", "AC")], "name string, seq string"), 2)
    got = sorted((x.name, x.strand, x.frame, x.s, x.e, x.aa) for x in df.collect())
    assert ("x", "+", 1, 2, 10, "MK*") in got
    assert ("x", "-", 0, 2, 13, "RLFH") in got and {x[0] for x in got} == {"x"}
    assert "transform(" not in df._jdf.queryExecution().toString()
