"""Queries against their SQL."""

import duckdb

from gapweave.queries import ORACLES, QUERIES


def test_parse_blocks_has_the_rows_and_columns_of_its_sql(spark, tmp_path):
    rows = [(1, 0, "user", "Hello\nthere"), (1, 1, "assistant", "Größe 日本"), (2, 0, "user", "One line")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = QUERIES["parse_blocks"](spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
        want = db.execute(ORACLES["parse_blocks"])
        assert found.columns == [c[0] for c in want.description]
        assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())


ODD = ["", "\n", "One\n\n\nTwo\n", "  led by spaces\nends with spaces  ", "\tone tab\nthe\ttab\t", "carriage\r\nreturn\r", "# head\n- item\n1. first\n> quote\n```\ncode", "a | b\n--- | ---\nc | d", "title\n===\n---", "<div>\n$$\n[x]: y\n    code", "The one\nplain\nThe two with\nThe three", "\r\n \n﷐﷐﷐ x", None, "Größe 日本\n\x85"]


def same_as_sql(spark, tmp_path, name, texts=ODD):
    rows = [(k, t, "en", "src *0* #", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = db.execute(ORACLES[name])
        assert found.columns == [c[0] for c in want.description]
        assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())


def test_parse_documents_shows_odd_lines_as_its_sql(spark, tmp_path):
    same_as_sql(spark, tmp_path, "parse_documents")


def test_pseudo_heading_takes_odd_lines_as_its_sql(spark, tmp_path):
    same_as_sql(spark, tmp_path, "pseudo_heading")


def test_split_long_paragraphs_splits_odd_lines_as_its_sql(spark, tmp_path):
    same_as_sql(spark, tmp_path, "split_long_paragraphs")


def test_auto_split_paragraphs_splits_odd_lines_as_its_sql(spark, tmp_path):
    same_as_sql(spark, tmp_path, "auto_split_paragraphs")
