from flowlens.operators import joins, split


def test_numbers_order_rows_where_keys_are_not_padded(spark):
    rows = [(str(i), i, "BENIGN" if i % 4 else "att") for i in range(1, 41)] + [("none", None, "BENIGN")]
    df = spark.createDataFrame(rows, "key string, no int, label string")
    assert {r["key"] for r in split.head(df, "key", "no", 6).collect()} == {"none", "1", "2", "3", "4", "5"}
    pilot = {r["key"] for r in split.pilot_sample(df, "key", "no", "label", 10).collect()}
    assert pilot == {"none", "1", "2", "3", "5", "6", "4", "8", "12", "16"}
    taken = df.where("no <= 10 or no is null")
    more = joins.top_up(split.with_row_order(df, "key", "no"), taken, "key", "_order", "_bucket", 3)
    assert {r["key"] for r in more.collect()} == {"11", "12", "13"}
