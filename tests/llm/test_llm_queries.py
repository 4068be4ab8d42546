from tarnlight.llm import queries as Q

COLUMNS = {
    "p1_found": ["listing_id_a", "listing_id_b"], "p3_found": ["page_id", "line_no"], "p5_found": ["page_id"], "p7_found": ["origin", "record_id", "brand_id"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "subject"],
}


def test_every_query_runs_without_duplicate_rows(spark, sf_dir):
    for name, query in Q.queries().items():
        df = query(spark, sf_dir)
        rows = df.collect()
        assert rows, name
        if name in COLUMNS:
            assert df.columns == COLUMNS[name]
            assert len({tuple(r) for r in rows}) == len(rows), name
