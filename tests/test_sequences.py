"""Sequence columns, read patterns, FASTQ and the library pipeline."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import seq as S
from loomgraph.operators import barcodes as B
from loomgraph.operators import reads as R
from loomgraph.operators.seqform import min_length, parse_form, parse_stack
from loomgraph.plans import library
from loomgraph.sources.fastq import read_fastq
from loomgraph.operators import consensus as K
from loomgraph.sources.settings import EmbeddingOptions, LibrarySettings, parse_options, parse_settings

PAIR = {"A": "T", "C": "G", "G": "C", "T": "A"}


def rc(s):
    return "".join(PAIR.get(c, "N") for c in reversed(s))


def one(spark, **cols):
    return spark.createDataFrame([("x",)], "d string").select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


def test_scalar_columns(spark):
    s = F.lit
    row = one(
        spark,
        rc=S.revcomp(s("AACGX")),
        del2=S.del_at(s("ACGT"), 2),
        ham=S.hamming(s("ACGT"), s("AGGA")),
        enc=S.base4_encode(s(27), 4),
        dec=S.base4_decode(s("ACGT")),
        bad=S.base4_decode(s("ACNT")),
        phred=S.mean_phred(s("?@A")),
        homo=S.longest_homopolymer(s("AACCCCG")),
        motif=S.motif_count(s("AAAAA"), "AA"),
        trim=S.trim_at(s("ACGTTTGGG"), ["GGG", "TTT"], 3),
        short=S.trim_at(s("ACGTTTGGG"), ["CG"], 3),
        ref=S.cigar_length(s("5M2I3D4N1=2X9S")),
        md=S.md_mismatches(s("10M"), s("3A2^AC1TG3"), s(100)),
        none=S.md_mismatches(s("10M"), s("10"), s(100)),
        dna=S.looks_like_dna(s("ACG;TN|a")),
        na=S.is_placeholder(s(" n/a ")),
    )
    assert row["rc"] == "NCGTT" and row["del2"] == "AGT" and row["ham"] == 2
    assert row["enc"] == "ACGT" and row["dec"] == 27 and row["bad"] == -1
    assert row["phred"] == 31 and row["homo"] == 4 and row["motif"] == 2
    assert row["trim"] == "ACG" and row["short"] is None and row["ref"] == 15
    assert row["md"] == "103~100~10>A+109~100~10>T+110~100~10>G" and row["none"] == "None"
    assert row["dna"] and row["na"]


def test_forms(spark):
    f = parse_form("P_0:4|U_NNW_4:7|A_7:|X_1:2")
    assert [b.kind for b in f.blocks] == ["P", "U", "A"] and min_length(f) == 7
    with pytest.raises(ValueError):
        parse_form("U_NN_0:5")
    assert parse_stack("*,0,1:revcomp+1,*,0")[0].revcomp
    reads = spark.createDataFrame([(1, "r", "ACATAACC", "GG"), (2, "r", "AGATAACC", "GG")], "read_no long, name string, read1 string, read2 string")
    p = R.parse_reads(reads, [parse_form("U_NNWG_5:1|A_5:")], []).orderBy("read_id").collect()
    # read backwards from position 5: N, N, W at 3, and G at 2, where the read has its complement
    assert [r.for_index for r in p] == [0, -1] and p[0].for_amp == "ACC"
    assert p[0].for_uxis == [rc("ATA")]


def test_settings():
    assert parse_settings("-u0 *,*,1\n-seqform_for A_1:\n-seqform_for U_NN_0:2")["-seqform_for"] == ["A_1:", "U_NN_0:2"]
    assert parse_options(["-a", "1", "-b", "-c", "2", "-a", "3"]) == {"-a": "1", "-b": True, "-c": "2"}
    assert parse_options(["-a", "1", "stray", "-b"]) == {"-a": "1"}
    assert R.subsample_depths(450_000) == [25_000, 50_000, 100_000, 200_000, 400_000]


def test_options_file(tmp_path):
    EmbeddingOptions(dim=3).save(str(tmp_path / "p.json"))
    assert EmbeddingOptions.load(str(tmp_path / "p.json")).dim == 3


def brute_clusters(reads):
    """Directional clustering on a dict of sequence -> reads, by definition."""
    seqs = sorted(reads)
    idx = {s: i for i, s in enumerate(seqs)}
    length = len(seqs[0])
    groups = []
    for p in range(length):
        keys = {}
        for s in seqs:
            keys.setdefault(s[:p] + s[p + 1 :], []).append(idx[s])
        for g, key in enumerate(sorted(keys)):
            if len(keys[key]) > 1:
                groups.append((str(p * len(seqs) + g), keys[key]))
    rnd = {}
    for _, members in groups:
        total = 0
        for m in sorted(members, key=lambda i: (reads[seqs[i]], f"{i},")):
            rnd[m] = rnd.get(m, reads[seqs[m]]) + total
            total += reads[seqs[m]]
    state = {m: (rnd[m], m) for m in rnd}
    while True:
        best = {}
        for name, members in groups:
            top = None
            for m in sorted(members, key=lambda i: (-rnd[i], i)):
                if top is not None and state[m][0] < top[0]:
                    offer = (-top[0], name, top[1])
                    best[m] = min(best.get(m, offer), offer)
                elif top is None or state[m][0] > top[0]:
                    top = state[m]
        if not best:
            break
        for m, (neg, _, clust) in best.items():
            state[m] = (-neg, clust)
    return {i: state[i][1] if i in state else i for i in range(len(seqs))}


def test_directional_clusters(spark):
    rng = random.Random(3)
    reads = {}
    for _ in range(12):
        core = "".join(rng.choice("ACGT") for _ in range(7))
        reads[core] = rng.randint(5, 30)
        for _ in range(10):
            p = rng.randrange(7)
            near = core[:p] + rng.choice("ACGT") + core[p + 1 :]
            reads.setdefault(near, rng.randint(1, 6))
    df = spark.createDataFrame([(s, n) for s, n in reads.items()], "s string, n int")
    stacked = df.select(F.explode(F.array_repeat("s", F.col("n"))).alias("seq"))
    uniq = B.unique_sequences(stacked)
    got, _ = B.directional_clusters(uniq, 7)
    assert {r.seq_idx: r.clust for r in got.collect()} == brute_clusters(reads)


def test_fastq_and_library(spark, tmp_path):
    rng = random.Random(1)
    umi0 = ["".join(rng.choice("ACGT") for _ in range(8)) for _ in range(6)]
    umi1 = ["".join(rng.choice("ACGT") for _ in range(8)) for _ in range(6)]
    r1, r2, truth = [], [], {}
    for u in range(30):
        a, b = umi0[u % 6], umi1[(u * 5 + u // 6) % 6]
        uei = "".join(rng.choice("ACGT") for _ in range(10))
        truth[(a, b)] = truth.get((a, b), 0) + 1
        for _ in range(3):
            low = rng.random() < 0.1
            q = "@" + "I" * 17 if not low else "!" * 18
            r1.append((a + uei, q))
            r2.append((b, "I" * 8))
            if low:
                r1.append((a + uei, "@" + "I" * 17))
                r2.append((b, "I" * 8))
    for name, rows in (("r1.fastq", r1), ("r2.fastq", r2)):
        (tmp_path / name).write_text("".join(f"@n{i} x\n{s}\n+\n{q}\n" for i, (s, q) in enumerate(rows)))
    settings = LibrarySettings.from_text(
        f"-source_for {tmp_path}/r1.fastq\n-source_rev {tmp_path}/r2.fastq\n-seqform_for U_NNNNNNNN_0:8|U_NNNNNNNNNN_8:18\n"
        "-seqform_rev U_NNNNNNNN_0:8\n-u0 *,*,0\n-u1 *,*,2\n-u2 *,*,1\n-min_uei_per_umi 1\n"
    )
    raw = read_fastq(spark, settings.source_for, 1, range_bytes=101).orderBy("read_no").collect()
    assert [(r.read_no, r.seq, r.qual) for r in raw] == [(i, s, q) for i, (s, q) in enumerate(r1)]
    lib = library.build(library.load_pairs(spark, settings, 1 << 20), settings)
    assert lib.parsed.count() == sum(q[0] != "!" for _, q in r1)
    assert lib.edges.agg(F.sum("n_uei")).first()[0] == 30
    assert lib.edges.count() == len(truth)
    inserts = library.inserts_of(lib.parsed, lib.clusters, settings)
    assert inserts.count() <= lib.parsed.count()


def test_stream(spark, tmp_path):
    from loomgraph.streaming import ingest

    rows = [(i, "n", "ACGT" if i % 3 else "GGGG", "TT") for i in range(30)]
    schema = ingest.PAIRS
    for part in range(3):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], schema).write.mode("append").parquet(str(tmp_path / "in"))
    forms = [parse_form("U_ANN_0:3")]
    ingest.count_barcodes(ingest.pair_stream(spark, str(tmp_path / "in"), 1), forms, [], str(tmp_path / "out"), str(tmp_path / "s1")).awaitTermination()
    assert {r.seq: r.n_reads for r in ingest.barcode_totals(spark, str(tmp_path / "out")).collect()} == {"CG": 20, "": 20}
    ingest.append_parsed(ingest.pair_stream(spark, str(tmp_path / "in")), forms, [], str(tmp_path / "p"), str(tmp_path / "s2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "p")).where("for_index = 0").count() == 20
    ingest.count_forms(ingest.pair_stream(spark, str(tmp_path / "in")), forms, [], "forms_now", str(tmp_path / "s3")).awaitTermination()
    assert spark.table("forms_now").where("for_index = -1").first().n == 10


# The two kinds of settings files that users ship, with the same flags.
CDNA = """-source_for ../R1_cdna.fastq
-source_rev ../R2_cdna.fastq
-seqform_for A_29:39
-seqform_rev U_GCTNWWNN_2:10
-seqform_rev U_GCTNWWNN_3:11
-amplicon_terminate NNNNN,GTTCAGACGTGT
-min_mean_qual 30
-filter_umi0_amp_len 10
-filter_umi1_amp_len 12
-u0 *,0,0:revcomp
-a0 *,0,0
-uei_classification 0,1;2,0
-add_sequences_to_labelfiles
-uei_matchfilepath ..//uei//
"""


def test_settings_flags():
    s = LibrarySettings.from_text(CDNA)
    assert s.source_for == ["../R1_cdna.fastq"] and len(s.rev_forms) == 2
    assert s.terminators == ["NNNNN", "GTTCAGACGTGT"]
    assert s.amp_len == (10, 12) and s.insert_window == 25
    assert s.uei_classification == [(0, 1), (2, 0)] and s.sequences_in_labels and s.uei_library == "..//uei//"
    assert s.uxis[0][0].revcomp and set(s.amplicons) == {0}
    bare = LibrarySettings.from_text("-source_for a\n-min_uei_per_umi 3\n")
    assert bare.amp_len == (None, None) and bare.terminators == [] and bare.min_uei_per_umi == 3 and not bare.sequences_in_labels


def test_settings_terminators_trim_inserts(spark):
    s = LibrarySettings.from_text(CDNA)
    named = spark.createDataFrame([("a", "ACGTACGTACGTACGGTTCAGACGTGTAAAA"), ("b", "ACGTACGTTTTTNNNNNAAAA"), ("c", "ACGTGTTCAGACGTGTAAAA")], "name string, consensus string")
    got = {r["name"]: r["fragment"] for r in K.trimmed(named, s.terminators, s.amp_len[0]).collect()}
    assert got == {"a": "ACGTACGTACGTACG", "b": "ACGTACGTTTTT"}
