"""Text tables of mixed separators and encodings."""

from __future__ import annotations

import pytest

from salespark.sources import files


def test_every_file_has_its_own_style(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Região;Valor;Nome\nNorte;1,5;\"x; y\"\n\nSão Paulo;2;\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("﻿Nome,Região\n\"a \"\"b\"\", c\",Sul\nRegião só,Ação\n".encode())
    (tmp_path / "c.txt").write_bytes("\r\nValor\tOutro\r\n7\tü\r\nValor\tOutro\r\n8\r\n".encode())
    found = files.read_mixed_tables(spark, str(tmp_path))
    assert found.columns == ["Nome", "Outro", "Região", "Valor", "_file"]
    rows = sorted((tuple(r)[:4] for r in found.collect()), key=str)
    want = [("x; y", None, "Norte", "1,5"), (None, None, "São Paulo", "2"), ('a "b", c', None, "Sul", None), ("Região só", None, "Ação", None), (None, "ü", None, "7"), (None, None, None, "8")]
    assert rows == sorted(want, key=str)


def test_a_long_file_is_split(spark, tmp_path):
    (tmp_path / "long.csv").write_text("k;v\n" + "".join(f"{i};á{i}\n" for i in range(30_000)), encoding="latin-1")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        found = files.read_mixed_tables(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() >= 1 and found.where("v = concat('á', k)").count() == 30_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_empty_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("\n\n")
    with pytest.raises(files.ImportFileError):
        files.read_mixed_tables(spark, str(tmp_path))
