import json

import pytest
from pyspark.sql import functions as F

from provenor.operators.quality import verify_written
from provenor.sinks import tables as sinks
from provenor.sources import files, landing, tables


def test_nested_index_without_cases(spark, tmp_path):
    hits = [
        {"file_id": "f1", "file_name": "a", "cases": [{"case_id": "c1", "samples": [
            {"sample_id": "s1", "sample_type": "Primary Tumor", "tissue_type": "Tumor"}, {"sample_id": "s2", "sample_type": "Solid Tissue Normal"}]}]},
        {"file_id": "f2", "file_name": "b", "acl": ["open"], "file_size": 3},
        {"file_name": "no id"},
    ]
    (tmp_path / "index.json").write_text(json.dumps({"data": {"hits": hits}}, indent=2))
    got = sorted(tuple(r) for r in files.read_nested_index(spark, str(tmp_path)).select("file_id", F.coalesce("case_id", F.lit("-")), F.coalesce("sample_id", F.lit("-")), "sample_group").collect())
    assert got == [("f1", "c1", "s1", "tumor"), ("f1", "c1", "s2", "normal"), ("f2", "-", "-", "other")]


def test_counts_with_lineage(spark, tmp_path):
    for fid, n in (("aa", 10), ("bb", 7)):
        d = tmp_path / f"file_id={fid}"
        d.mkdir()
        (d / f"{fid}.tsv").write_text(
            "# gene-model: v36\ngene_id\tgene_name\tgene_type\tunstranded\ttpm_unstranded\n"
            f"N_unmapped\t\t\t123\t\nENSG1.5\tAAA\tprotein_coding\t{n}\t1.5\n"
        )
    raw = files.read_counts(spark, f"{tmp_path}/file_id=*/*.tsv")
    got = sorted((r.file_id, r.file_name, r.gene_id, r.unstranded) for r in raw.collect())
    assert got == [("aa", "aa.tsv", "ENSG1.5", "10"), ("aa", "aa.tsv", "N_unmapped", "123"), ("bb", "bb.tsv", "ENSG1.5", "7"), ("bb", "bb.tsv", "N_unmapped", "123")]
    inventory = files.file_inventory(spark, f"{tmp_path}/file_id=*/*.tsv")
    assert sorted((r.file_id, r.count_file_name) for r in inventory.collect()) == [("aa", "aa.tsv"), ("bb", "bb.tsv")]


def test_link_and_alias_text(spark, tmp_path):
    (tmp_path / "links.txt").write_text("protein1 protein2 combined_score\n# c\n\n9606.A 9606.B 500\n 9606.B  9606.C 1000 x\nshort line\n9606.D 9606.E n/a\n")
    (tmp_path / "alias.txt").write_text("#string_protein_id\talias\tsource\n9606.A\tTP 53\tEnsembl_HGNC_symbol\n9606.B X Y\n9606.C\tonly\n")
    assert sorted(tuple(r) for r in files.read_edge_text(spark, str(tmp_path / "links.txt")).collect()) == [("9606.A", "9606.B", 500.0), ("9606.B", "9606.C", 1000.0)]
    assert sorted(tuple(r) for r in files.read_alias_text(spark, str(tmp_path / "alias.txt")).collect()) == [("9606.A", "TP 53", "Ensembl_HGNC_symbol"), ("9606.B", "X", "Y")]


def test_sections_keep_file_order_across_splits(spark, tmp_path):
    body = "".join(f"g{i}\td{i}\t{i}.5\t{i}\r\n" for i in range(3000))
    (tmp_path / "m.txt").write_text("intro\nID_REF\tno\n" * 5 + "ID_REF\tDescription\tS.1\tS2\r\n" + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = files.read_from_header(spark, str(tmp_path / "m.txt"))
        assert df.columns == ["ID_REF", "Description", "S.1", "S2"]
        assert df.count() == 3000
        assert df.where("ID_REF = 'g17'").first()["S.1"] == "17.5"
        assert df.agg(F.sum(F.col("S2").cast("int"))).first()[0] == sum(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_every_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\nID_REF\tS1\tS2\ng1\t1\t2\ng2\t3\t\"a\tb\"\n")
    (tmp_path / "b c.txt").write_text("ID_REF\tS2\tS1\tS3\ng1\t20\t10\t30\n")
    got = sorted((tuple(r) for r in files.read_from_header(spark, str(tmp_path), "ID_REF").collect()), key=str)
    assert got == [("g1", "1", "2", None), ("g1", "10", "20", "30"), ("g2", "3", "a\tb", None)]
    (tmp_path / "none.txt").write_text("no header\n")
    with pytest.raises(ValueError, match="none.txt"):
        files.read_from_header(spark, str(tmp_path), "ID_REF")


def test_section_between_markers(spark, tmp_path):
    (tmp_path / "soft.txt").write_text(
        "!series_table_end\n!x\n!series_table_begin = Clinical_annotations_curated\nOriginal Study\tCohort\tMergeGroup\tArray\nA\tB\tC\tS1\r\nA\tB\tD\tS2\n!series_table_end\nrest\n!series_table_end\n"
    )
    df = files.read_between(spark, str(tmp_path / "soft.txt"))
    assert sorted((r.MergeGroup, r.Array) for r in df.collect()) == [("C", "S1"), ("D", "S2")]
    with pytest.raises(ValueError):
        files.read_between(spark, str(tmp_path / "soft.txt"), begin="!absent")
    with pytest.raises(ValueError):
        files.read_from_header(spark, str(tmp_path / "soft.txt"), "NO SUCH HEADER")


def test_snapshot_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"items": [{"x": 1}, {"x": 2}], "source": "s"}, indent=2))
    (tmp_path / "b.json").write_text(json.dumps([{"x": 3}], indent=2))
    sinks.write_snapshot(spark.createDataFrame([(4, float("nan"))], "x int, y double"), str(tmp_path / "c"))
    assert sorted(r.x for r in tables.read_snapshot(spark, str(tmp_path), "a").collect()) == [1, 2]
    assert [r.x for r in tables.read_snapshot(spark, str(tmp_path), "b").collect()] == [3]
    c = tables.read_snapshot(spark, str(tmp_path), "c", "x int, y double").collect()
    assert [(r.x, r.y) for r in c] == [(4, None)]
    assert tables.read_snapshot(spark, str(tmp_path), "absent", "x int").collect() == []
    assert tables.read_snapshot(spark, str(tmp_path), "absent").columns == ["available"]


def test_landing(spark, tmp_path):
    d = tmp_path / "links" / "run_date=2024-01-07"
    d.mkdir(parents=True)
    (d / "l.txt.gz").write_bytes(b"abc")
    (d / "extra.gz").write_bytes(b"x")
    manifest = spark.createDataFrame([("links", "l.txt.gz", "links", 3), ("aliases", "a.txt.gz", "aliases", 5), ("x", "extra.gz", "links", 9)], "dataset string, filename string, hdfs_subdir string, size bigint")
    plan = {r.dataset: r.raw_path for r in landing.plan_manifest(manifest, "/raw", "2024-01-07").collect()}
    assert plan["aliases"] == "/raw/aliases/run_date=2024-01-07/a.txt.gz"
    seen = landing.landed_files(spark, f"{tmp_path}/links/*/*")
    done, failed = landing.split_landed(landing.index_landed(manifest, seen, "filename", ["size"]))
    assert [(r.dataset, r.landed_size) for r in done.collect()] == [("links", 3)]
    assert sorted((r.dataset, r.status) for r in failed.collect()) == [("aliases", "missing"), ("x", "mismatched")]


def test_line_digests(spark, tmp_path):
    for name, text in (("a.txt", "x\ny\n"), ("b.txt", "y\nx\n"), ("c.txt", "x\nz\n")):
        (tmp_path / name).write_text(text)
    got = {r.filename: (r.n_lines, r.digest) for r in landing.line_digests(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == got["b.txt"] != got["c.txt"] and got["c.txt"][0] == 2


def test_landing_stream_is_incremental(spark, tmp_path):
    from provenor.streaming.landing import index_new_files

    src, out, ck = tmp_path / "raw", str(tmp_path / "index"), str(tmp_path / "ck")
    for day, name in (("2024-01-07", "a.gz"), ("2024-01-14", "b.gz")):
        d = src / "links" / f"run_date={day}"
        d.mkdir(parents=True)
        (d / name).write_bytes(b"abc")
        index_new_files(spark, str(src), out, ck).awaitTermination(120)
    assert sorted((r.run_date, r.filename, r.size) for r in spark.read.parquet(out).collect()) == [("2024-01-07", "a.gz", 3), ("2024-01-14", "b.gz", 3)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("tumor", 1), ("normal", 2)], "g string, v int")
    path = str(tmp_path / "t")
    sinks.write_table(df, path, ["g"])
    sinks.write_table(spark.createDataFrame([("tumor", 9)], "g string, v int"), path, ["g"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("g", "v").collect()) == [("normal", 2), ("tumor", 9)]
    verify_written(spark, path, rows=2)
    with pytest.raises(AssertionError):
        verify_written(spark, path, rows=3)
    out = tmp_path / "csv"
    sinks.export_csv(spark.createDataFrame([("=1", 2.5), ('q"', -1.0)], "name string, v double"), str(out), [F.col("v").desc()])
    text = "".join(p.read_text(encoding="utf-8") for p in sorted(out.glob("part-*")))
    assert text == '\ufeff"name","v"\n"\'=1","2.5"\n"q""","\'-1.0"\n'
