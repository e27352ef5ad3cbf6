"""Readers and writers on small literals."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import chains, pairs
from sparkloom.sources import formats
from sparkloom.streaming import windows


def put(tmp_path, text, name="x.txt"):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_fasta(spark, tmp_path):
    df = formats.read_fasta(spark, put(tmp_path, ">a first one\nACGT\nacgt\n>b\n\n>c x\nNN\n"))
    assert sorted(rows(df)) == [("a", "first one", "ACGTacgt"), ("b", "", ""), ("c", "x", "NN")]
    formats.write_fasta(df.select("name", "seq"), str(tmp_path / "out"), line=3)
    again = formats.read_fasta(spark, str(tmp_path / "out"))
    assert sorted((r.name, r.seq) for r in again.collect()) == [("a", "ACGTacgt"), ("b", ""), ("c", "NN")]


def test_fastq(spark, tmp_path):
    df = formats.read_fastq(spark, put(tmp_path, "@r1 x\nACGT\n+\nIIII\n@r2\nAC\n+r2\n@@\n"))
    assert sorted(rows(df)) == [("r1", "x", "ACGT", "IIII"), ("r2", "", "AC", "@@")]
    with pytest.raises(Exception, match="bad FASTQ"):
        formats.read_fastq(spark, put(tmp_path, "@r1\nACGT\n+\nIII\n", "bad.fq")).collect()


def test_tables(spark, tmp_path):
    assert rows(formats.read_sizes(spark, put(tmp_path, "I\t230218\nII\t813184\n"))) == [("I", 230218), ("II", 813184)]
    assert [r.name for r in formats.read_names(spark, put(tmp_path, "a\n#c\n\nb\n")).collect()] == ["a", "b"]
    assert rows(formats.read_replace(spark, put(tmp_path, "read0\t359\tx\n"))) == [("read0", "359"), ("read0", "x")]
    got = rows(formats.read_ranges(spark, put(tmp_path, "I:1-100\nS288c.I(-):190-200\nbad\ninfile_0/1/0_514:19-25\n")))
    assert got == [("I:1-100", "", "I", "", 1, 100), ("S288c.I(-):190-200", "S288c", "I", "-", 190, 200), ("infile_0/1/0_514:19-25", "", "infile_0/1/0_514", "", 19, 25)]


def test_runlists(spark, tmp_path):
    one = formats.read_runlist(spark, put(tmp_path, '{"I": "1-3,5,7-9", "II": "-"}'))
    assert rows(one) == [("__single__", "I", 1, 3), ("__single__", "I", 5, 5), ("__single__", "I", 7, 9)]
    many = formats.read_runlist(spark, put(tmp_path, '{"A": {"1": "3631-3913"}, "B": {"2": "7"}}', "many.json"))
    assert rows(many) == [("A", "1", 3631, 3913), ("B", "2", 7, 7)]
    assert formats.runlist_json(one.select("chr", "s", "e")).first().json == '{"I":"1-3,5,7-9"}'


PSL = "59\t9\t0\t0\t1\t823\t1\t96\t+-\tq\t100\t10\t78\tt\t500\t20\t184\t2\t40,28,\t10,50,\t316,452,"


def test_psl_round_trip(spark, tmp_path):
    df = formats.read_psl(spark, put(tmp_path, "psLayout version 3\n\nmatch\tmis\n-----\n" + PSL + "\n"))
    r = df.first()
    assert (r.match, r.strand, r.q_name, r.block_sizes, r.t_starts) == (59, "+-", "q", [40, 28], [316, 452])
    formats.write_psl(df, str(tmp_path / "out"))
    assert [x.value for x in spark.read.text(str(tmp_path / "out")).collect()] == [PSL]


def test_alignment_formats(spark, tmp_path):
    paf = formats.read_paf(spark, put(tmp_path, "q1\t2000\t100\t900\t+\tt1\t2000\t50\t850\t720\t800\t60\ttp:A:P\tcg:Z:800M\n")).first()
    assert (paf.q_name, paf.t_end, paf.cg) == ("q1", 850, "800M")
    chain = formats.read_chain(spark, put(tmp_path, "# c\nchain 137753 chr22 49476972 + 14788390 14791342 chr8 128923138 + 119593617 119610147 3\n438 3 0\n176\n\nchain 5 a 9 + 0 3 b 9 - 0 3 4\n3\n")).orderBy("id").collect()
    assert [(c.score, c.t_name, [tuple(b) for b in c.blocks]) for c in chain] == [(137753.0, "chr22", [(438, 3, 0), (176, 0, 0)]), (5.0, "a", [(3, 0, 0)])]
    axt = formats.read_axt(spark, put(tmp_path, "0 chr22 5 7 chr22 8 10 - 96\nACG\nA-G\n\n1 c 1 1 d 2 2 + 9\nA\nA\n")).orderBy("id").collect()
    assert [(a.t_name, a.q_strand, a.t_text, a.q_text) for a in axt] == [("chr22", "-", "ACG", "A-G"), ("c", "+", "A", "A")]
    maf = formats.read_maf(spark, put(tmp_path, "##maf version=1\na score=3.5\ns ce6.chrII 14647617 3 + 15279323 ACG\ns b.c 1 2 - 9 A-G\n\n")).first()
    assert (maf.score, [c.src for c in maf.comps], maf.comps[1].text) == (3.5, ["ce6.chrII", "b.c"], "A-G")


def test_gff_net_and_blocks(spark, tmp_path):
    gff = formats.read_gff(spark, put(tmp_path, "##gff\nchr22\ta\tCDS\t18\t41\t.\t+\t0\tgene_id RANBP1; note \"x\"\nI\tb\tgene\t1\t9\t.\t-\t.\tID=g1;Name=n\n")).orderBy("s").collect()
    assert [(g.type, g.attrs) for g in gff] == [("gene", {"ID": "g1", "Name": "n"}), ("CDS", {"gene_id": "RANBP1", "note": "x"})]
    net = formats.read_net(spark, put(tmp_path, "net c1 100\n fill 1 90 c3 + 5 90 id 4 score 16 type top\n  gap 20 7 c3 + 30 0\n   fill 21 5 cU + 8 5 id 6 score 3\n fill 95 4 c9 - 1 4 id 7 score 2\n")).orderBy("node_id").collect()
    ids = {n.node_id: i for i, n in enumerate(net)}
    assert [(n.kind, n.depth, ids.get(n.parent_id)) for n in net] == [("fill", 1, None), ("gap", 2, 0), ("fill", 3, 1), ("fill", 1, None)]
    assert net[0].attrs["score"] == "16" and net[0].attrs["type"] == "top"
    fas = formats.read_blocks(spark, put(tmp_path, ">S288c.I(+):13267-13287\nTCGT\n>b.I(-):1-4\nTC-T\n\n>c.II(+):3-5\nAAA\n\n")).orderBy("block_id", "idx").collect()
    assert [(f.idx, f.name, f.chr, f.s, f.seq) for f in fas] == [(0, "S288c", "I", 13267, "TCGT"), (1, "b", "I", 1, "TC-T"), (0, "c", "II", 3, "AAA")]


def test_gap_costs_and_chaining(spark):
    assert chains.gap_cost([1, 1, 0], [0, 1, 0]).tolist() == [325, 660, 0]
    b = spark.createDataFrame([("t", "q", "+", 0, 0, 50, 5000), ("t", "q", "+", 100, 110, 50, 5000), ("t", "q", "+", 900_000, 10, 50, 5000)], "t_name string, q_name string, strand string, t long, q long, n long, score long")
    got = sorted(tuple(r) for r in chains.chain_blocks(b).select("t_start", "t_end", "blocks", "score").collect())
    assert got == [(0, 150, 2, 10000 - chains.gap_cost(60, 50).item()), (900_000, 900_050, 1, 5000.0)]


def test_net_fills_free_space(spark):
    c = spark.createDataFrame([("t", 10, 100, "a", "+", 9.0), ("t", 0, 200, "b", "+", 5.0)], "t_name string, t_start long, t_end long, q_name string, strand string, score double")
    got = sorted((r.s, r.e, r.q_name) for r in chains.net(c, min_space=1, min_fill=1).collect())
    assert got == [(0, 10, "b"), (10, 100, "a"), (100, 200, "b")]


def test_pairs_and_archives(spark):
    p = pairs.pair_counts(spark.createDataFrame([("ACG-T-", "AAGTT-")], "t_text string, q_text string")).first()
    assert (p.cg, p.match, p.mismatch, p.q_base_insert, p.t_base_insert) == ("1=1X1=1I1=", 3, 1, 1, 0)
    own = spark.createDataFrame([("s", "r", "AAAACCCCG"), ("u", "r", "TTTTCCCC")], "sample string, ref string, seq string")
    ref = spark.createDataFrame([("r", "AAAACCCC")], "ref string, seq string")
    arch = pairs.archive(own, ref, 4)
    assert sorted((r.sample, r.seg, r.encoding) for r in arch.collect()) == [("s", 0, "identity"), ("s", 1, "identity"), ("s", 2, "raw"), ("u", 0, "raw"), ("u", 1, "identity")]
    assert sorted(rows(pairs.restore(arch, ref, 4))) == [("s", "AAAACCCCG"), ("u", "TTTTCCCC")]


def test_streaming_windows(spark, tmp_path):
    batch = spark.createDataFrame([(i * 1800, "a", 1.0) for i in range(6)], "t long, k string, value double").select(F.timestamp_seconds("t").alias("ts"), "k", "value")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling(stream, "ts", "1 hour", "1 hour", ["k"]).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("tumbled").collect()) == [2, 2, 2]
    assert [r.n for r in windows.sessions(batch, "ts", "1 hour", "1 day", ["k"]).collect()] == [6]
