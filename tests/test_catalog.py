"""Every query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from strandloom.operators import hits as H
from strandloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[str]:
    def plain(v):
        if v is None or pd.isna(v):
            return None
        return str(v) if isinstance(v, (str, bool, pd.Timestamp)) else round(float(v), 6)

    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_points(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_alignments_replay(spark):
    from strandloom.functions.alignment import affine_score, cigar_and_md

    got = catalog.QUERIES["aligned_reads"](spark, SF).toPandas()
    assert len(got)
    for r in got.itertuples():
        assert (r.cigar, r.md) == cigar_and_md(r.ext)
        assert (r.score, r.events) == affine_score(r.ext)


def test_clusters_from_previous_sort_rows_once(spark, capsys):
    """Other columns stay with their hit, also of null places; a task holds its rows in one sort."""
    rows = [(1, 1, 100, "+", 2, "a"), (1, 1, 110, "+", 1, "b"), (1, 1, 118, "-", 1, "c"), (1, 1, 131, "+", 0, "d"), (1, 2, None, "+", 5, "e"), (1, 2, 3, "+", 7, "f"), (2, 1, 119, "+", 3, "g")]
    hits = spark.createDataFrame(rows, "read_id long, contig_id long, pos long, strand string, ed long, more string")
    got = H.clusters_from_previous(hits)
    got.explain()
    assert capsys.readouterr().out.count("Sort [") == 1
    assert got.columns == hits.columns
    assert {r.more: tuple(r) for r in got.collect()} == {r[5]: r for r in rows if r[5] in "bdefg"}


def test_clusters_from_previous_with_nulls_and_alike_rows(spark, tmp_path):
    """Nulls come last in the SQL's orders, and it rounds; rows alike are one hit, where the SQL may count them in either order."""
    lines = [(1, 100, 3, 1, 5.0), (1, 104, 3, 1, None), (1, 300, 3, 2, None), (1, 305, 3, 1, None), (1, None, 3, 1, 2.0), (2, 7, None, 1, None), (2, 9, None, 3, 6.0), (3, 50, 3, 1, None), (3, 52, 3, 2, 7.0), (4, 60, 3, 1, 2.5), (4, 61, 3, 2, 1.7), (4, 90, 3, 1, 3.5)]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"
    spark.createDataFrame(lines, columns).coalesce(1).write.parquet(str(tmp_path / "a" / "lineitem.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/a/lineitem.parquet/*.parquet'")
    want = con.sql(catalog.ORACLES["clusters_from_previous"]).df()
    assert rows(catalog.clusters_from_previous(spark, str(tmp_path / "a")).toPandas()) == rows(want)
    spark.createDataFrame(lines * 3, columns).coalesce(1).where("l_partkey IS NOT NULL").write.parquet(str(tmp_path / "b" / "lineitem.parquet"))
    assert rows(catalog.clusters_from_previous(spark, str(tmp_path / "b")).toPandas()) == rows(want[want.pos.notna()])


def test_clusters_from_first_against_a_plain_fold(spark):
    hits = catalog.hits(spark, SF).toPandas()
    want = set()
    for (read, contig), g in hits.groupby(["read_id", "contig_id"]):
        kept, first = [], None
        for pos, ed, strand in sorted(zip(g.pos, g.ed, g.strand)):
            if first is not None and pos - first <= 12:
                if ed < kept[-1][1]:
                    kept[-1] = (pos, ed, strand)
            else:
                first = pos
                kept.append((pos, ed, strand))
        want |= {(read, contig, *k) for k in kept}
    got = catalog.QUERIES["clusters_from_first"](spark, SF).toPandas()
    assert {tuple(r) for r in got[["read_id", "contig_id", "pos", "ed", "strand"]].itertuples(index=False)} == want and len(got) == len(want)


def test_every_variant_meets_the_hits(spark):
    """Against brute force over all rows of part; the output grows with the tables, not with their square."""
    line, part = pd.read_parquet(f"{SF}/lineitem.parquet"), pd.read_parquet(f"{SF}/part.parquet")
    line["pos"] = line.l_partkey % 100 * 100 + line.l_linenumber * 7
    line["last"] = line["pos"] + 60 + line.l_suppkey % 40
    part["first"] = part.p_partkey % 100 * 100 + part.p_size
    met = line.assign(c=line.l_partkey // 100).merge(part.assign(c=part.p_partkey // 100, end=part["first"] + part.p_size % 5), on="c")
    met = met[(met.pos <= met.end) & (met["first"] <= met["last"])]
    want = met.groupby(["l_orderkey", "l_linenumber", "c", "pos", "p_partkey"]).size().reset_index()
    got = catalog.QUERIES["hits_over_variants"](spark, SF).toPandas()
    assert rows(got[["read_id", "mate", "contig_id", "pos", "variant", "n"]].set_axis(list("abcdef"), axis=1)) == rows(want.set_axis(list("abcdef"), axis=1))
    assert len(line) / 2 < len(got) < 4 * len(line)
