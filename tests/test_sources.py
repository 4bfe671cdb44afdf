"""Readers, writers and reuse of saved artifacts."""

import pytest
from pyspark.sql import functions as F

from molspark.sources import readers, writers


def test_empty_table_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("smiles,property\n")
    with pytest.raises(ValueError):
        readers.read_labeled(spark, str(tmp_path / "a.csv"))


def test_trailing_blanks_are_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("smiles,property\nCCO ,-4.02\nCN,1\n")
    rows = readers.read_labeled(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in rows] == [("CCO ", -4.02), ("CN", 1.0)]


def test_smi_lines(spark, tmp_path):
    (tmp_path / "a.smi").write_text("CCO ethanol  x\nCN\n\nC\tmethane\n")
    rows = readers.read_smi(spark, str(tmp_path / "a.smi")).collect()
    assert [tuple(r) for r in rows] == [("CCO", "ethanol  x"), ("CN", None), ("C", "methane")]


def test_sdf_records(spark, tmp_path):
    record = "{}\n\n\nM  END\n> <{}>\n{}\n\n$$$$\n"
    (tmp_path / "a.sdf").write_text(record.format("m1", "LOGP", "1.5") + record.format("m2", "MW", "46"))
    rows = readers.read_sdf(spark, str(tmp_path / "a.sdf"), ["LOGP", "MW"]).collect()
    assert sorted(tuple(r) for r in rows) == [("m1", "1.5", None), ("m2", None, "46")]


def test_manifest_from_files(spark, tmp_path):
    for f in range(3):
        for r in range(2):
            (tmp_path / f"d_Model_Fold_{f}_Run_{r}.hdf5").write_text("x")
    (tmp_path / "d_Scaler_Extra_Fold_0.pkl").write_text("x")
    row = readers.manifest(readers.artifact_paths(spark, str(tmp_path))).first()
    assert tuple(row) == (3, 2, False, True)


def test_saved_artifact_wins(spark, tmp_path):
    path = str(tmp_path / "vocab")
    make = lambda t: spark.createDataFrame([(t, 2)], writers.VOCABULARY_SCHEMA)
    assert writers.saved_vocabulary(spark, path, lambda: make("a")).first()["token"] == "a"
    assert writers.saved_vocabulary(spark, path, lambda: make("b")).first()["token"] == "a"


def test_ranked_file_is_in_order(spark, tmp_path):
    path = str(tmp_path / "ranked")
    writers.write_ranked(spark.range(500).select(F.col("id").alias("smiles"), (F.col("id") * 37 % 500).alias("property")), path)
    lines = [line.split(",") for f in sorted((tmp_path / "ranked").glob("part-*")) for line in f.read_text().splitlines()]
    values = [int(v) for _, v in lines if v != "property"]
    assert values == sorted(range(500), reverse=True)


def test_score_report(spark, tmp_path):
    df = spark.createDataFrame([("C", "a", 1.25), (None, "b", 2.0), ("N", "c", None)], "smiles string, name string, sa_score double")
    writers.write_score_report(df, str(tmp_path / "r"))
    text = "".join(f.read_text() for f in (tmp_path / "r").glob("part-*"))
    assert "C\ta\t1.250000" in text and "N\tc\tNone" in text and "\tb\t" not in text


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,property,smiles\n1,2.5,"a ""b"", c\nnext"\n2,-1,C\\N\n')
    rows = readers.read_labeled(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in rows] == [('a "b", c\nnext', 2.5), ("C\\N", -1.0)]


@pytest.mark.parametrize("text", ["smiles,property\nC,abc\n", "smiles,property\nC,1,2\n", "smiles,value\nC,1\n"])
def test_malformed_tables_are_errors(spark, tmp_path, text):
    (tmp_path / "a.csv").write_text(text)
    with pytest.raises(Exception):
        readers.read_labeled(spark, str(tmp_path / "a.csv")).collect()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_sdf_values_of_several_lines(spark, tmp_path, end):
    text = "\nline\n\nM  END\n> <note+>\none\ntwo\n\n> <b>\nx\n> <c>\n$$$$\nm2\n\n\nM  END\n> <b>\n\n$$$$\n"
    (tmp_path / "a.sdf").write_bytes(text.replace("\n", end).encode())
    rows = readers.read_sdf(spark, str(tmp_path / "a.sdf"), ["note+", "b", "c", "d"]).collect()
    assert sorted(tuple(r) for r in rows) == [("", "one\ntwo", "x", "", None), ("m2", None, "", None, None)]
