"""2bit records and files, packed k-mers, windows from pieces and CIGAR projection against plain Python."""

import random
import struct

import pyarrow as pa
import pytest

from sparkloom.operators import alignments, kmers, sequences
from sparkloom.sources import twobit


def dna(seed, n, letters="ACGTacgtNn-R"):
    r = random.Random(seed)
    return "".join(r.choice(letters) for _ in range(n))


def plain(seq):
    return "".join(c if c in "ACGTacgt" else "N" for c in seq)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 63, 1000])
def test_record_round_trip(n):
    seq = dna(n, n)
    rec = twobit.encode(seq.encode())
    assert twobit.decode(rec).decode() == plain(seq)
    assert twobit.decode(rec, mask=False).decode() == plain(seq).upper()
    for s, e in [(0, n), (1, n), (2, 7), (5, 6), (n, n)]:
        if s <= n:
            assert twobit.decode(rec, s, e).decode() == plain(seq)[s:e]
    with pytest.raises(ValueError):
        twobit.decode(rec, n + 1)


def test_record_layout():
    # four bases a byte, the first in the high bits: T C A G are 0 to 3
    rec = twobit.encode(b"TCAGNNt")
    assert rec == struct.pack("<IIIIIIII", 7, 1, 4, 2, 1, 6, 1, 0) + bytes([0b00011011, 0])


def test_file_orders_and_versions():
    named = [("a", twobit.encode(b"ACGT")), ("seq two", twobit.encode(dna(1, 50).encode()))]
    content = twobit.file_bytes(named)
    assert [(n, twobit.decode(r, order=o).decode()) for n, r, o in twobit.parse_file(content)] == [("a", "ACGT"), ("seq two", plain(dna(1, 50)))]
    big = struct.pack(">IIII", twobit.MAGIC, 0, 1, 0) + b"\x01z" + struct.pack(">I", 22) + struct.pack(">IIII", 4, 0, 0, 0) + bytes([0b10011100])
    assert [(n, twobit.decode(r, order=o).decode()) for n, r, o in twobit.parse_file(big)] == [("z", "ACGT")]
    with pytest.raises(ValueError):
        twobit.parse_file(b"\x00" * 16)


def test_files_written_and_read(spark, tmp_path):
    rows = [(f"s{i}", dna(i, i * 13)) for i in range(20)]
    df = spark.createDataFrame(rows, "name string, seq string").repartition(3)
    files = twobit.write(df, f"file://{tmp_path}/out").collect()
    assert sum(f.sequences for f in files) == 20
    got = {r.name: r.seq for r in twobit.read(spark, f"{tmp_path}/out").collect()}
    assert got == {n: plain(s) for n, s in rows}


def test_tables_and_ranges(spark):
    recs = twobit.records(spark.createDataFrame([("x", "ACNNgtACGnacg")], "name string, seq string"))
    assert [tuple(r) for r in twobit.sizes(recs).collect()] == [("x", 13, 10)]
    assert [tuple(r)[1:] for r in twobit.masked(recs).collect()] == [(3, 6), (10, 13)]
    assert [tuple(r)[1:] for r in twobit.masked(recs, gaps_only=True).collect()] == [(3, 4), (10, 10)]
    ranges = spark.createDataFrame([("x", 2, 5, "+"), ("x", 2, 5, "-")], "name string, s long, e long, strand string")
    assert sorted(r.seq for r in twobit.extract(recs, ranges).collect()) == ["CNNg", "cNNG"]


@pytest.mark.parametrize("k", [1, 2, 5, 11, 16, 17, 21, 31])
@pytest.mark.parametrize("canonical", [True, False])
def test_packed_kmers(k, canonical):
    texts = [dna(k, 200, "ACGT"), "", dna(7, 90, "ACGTN"), "ACG", None, dna(9, 300, "AC")]
    comp = str.maketrans("ACGT", "TGCA")
    want = []
    for t in texts:
        for i in range(len(t or "") - k + 1):
            w = t[i : i + k]
            if set(w) <= set("ACGT"):
                want.append(min(w, w.translate(comp)[::-1]) if canonical else w)
    keys = kmers.pack(*kmers._bytes(pa.array(texts, pa.string())), k, canonical)
    assert [sum("ACGT".index(c) << 2 * (k - 1 - i) for i, c in enumerate(w)) for w in want] == keys.tolist()


@pytest.mark.parametrize("k", [3, 13, 33])
def test_kmer_table(spark, k):
    texts = [dna(1, 300, "ACGT"), dna(1, 300, "ACGT"), dna(2, 100, "ACGTN")]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "name string, seq string")
    comp, want = str.maketrans("ACGT", "TGCA"), {}
    for t in texts:
        for i in range(len(t) - k + 1):
            w = t[i : i + k]
            if "N" not in w:
                w = min(w, w.translate(comp)[::-1])
                want[w] = want.get(w, 0) + 1
    assert {r.kmer: r.n for r in kmers.table(df, k).collect()} == want


@pytest.mark.parametrize("size, step", [(4, 2), (5, 3), (3, 5), (7, 7)])
def test_windows(spark, size, step):
    rows = [("a", "ACGTNNNNNNNNNNacgtac\nx"), ("b", "A"), ("c", ""), ("d", "né" * 9)]
    want = []
    for n, s in rows:
        for at in range(0, len(s), step):
            w = s[at : at + size]
            if w.strip("Nn"):
                want.append((n, at + 1, min(at + size, len(s)), w))
    got = sequences.windows(spark.createDataFrame(rows, "name string, seq string"), size, step)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def project(ops, t_start, q_start, q_end, strand, s, e):
    """Column by column: what a stretch of the target covers."""
    ct, cq, q, t = t_start, 0, [], []
    for n, op in ops:
        if op == "I":
            if s <= ct < e:
                q += [cq, cq + n]
            cq += n
            continue
        for _ in range(n):
            if s <= ct < e:
                t.append(ct)
                if op != "D":
                    q += [cq, cq + 1]
            ct += 1
            cq += op != "D"
    if not q or not t or min(q) >= max(q):
        return None
    lo, hi = min(q), max(q)
    return (min(t), max(t) + 1) + ((q_end - hi, q_end - lo) if strand == "-" else (q_start + lo, q_start + hi))


def test_paf_query_follows_the_cigar(spark):
    r, rows, regions = random.Random(3), [], []
    for i in range(40):
        ops = [(r.randint(1, 6), r.choice("M=XID")) for _ in range(r.randint(1, 6))]
        t = sum(n for n, o in ops if o != "I")
        q = sum(n for n, o in ops if o != "D")
        rows.append((f"q{i}", 10, 10 + q, r.choice("+-"), f"t{i}", 5, 5 + t, 1, 1, "".join(f"{n}{o}" for n, o in ops), ops))
        regions.append((f"t{i}", r.randint(0, 10), r.randint(11, 30)))
    rows.append(("plain", 0, 20, "-", "line", 0, 20, 1, 1, "", []))
    regions.append(("line", 5, 9))
    df = spark.createDataFrame([x[:10] for x in rows], "q_name string, q_start long, q_end long, strand string, t_name string, t_start long, t_end long, matches long, block_len long, cg string")
    got = {x.q_name: (x.t_from, x.t_to, x.q_from, x.q_to) for x in alignments.paf_query(df, spark.createDataFrame(regions, "t_name string, s long, e long")).collect()}
    want = {}
    for x, (_, s, e) in zip(rows[:-1], regions):
        p = project(x[10], x[5], x[1], x[2], x[3], s, e)
        if p:
            want[x[0]] = p
    assert got == want | {"plain": (5, 9, 11, 15)}
