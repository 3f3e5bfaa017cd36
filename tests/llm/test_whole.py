"""What an operator must not leave out: checks on inputs beyond the bounds of what is sent to the tasks."""

from harrow.llm import decontam


def test_leaks_of_items_full_of_placeholders(spark):
    """Items of mostly numbers, units and names are found, word for word and with other values; so are quoted ones."""
    items = [
        (1, "Convert 5 km to 12 miles"), (2, "Alice ran 12 km Monday, Bob ran 9 km Tuesday, Carol ran 7 km Friday; total km?"),
        (3, "Anna Bert Carl Dora Emil Fritz Gerd Hans Ida Jan"), (4, "What is the capital city of the northern province"),
        (5, "What is the sum of 12 and 30 then"),
    ]
    texts = [
        (1, "they said Convert 5 km to 12 miles today"), (2, "so, Alice ran 12 km Monday, Bob ran 9 km Tuesday, Carol ran 7 km Friday; total km? yes"),
        (3, "list: Anna Bert Carl Dora Emil Fritz Gerd Hans Ida Jan"), (4, 'asked, "What is the capital city of the northern province"'),
        (5, "asked, What is the sum of 17 and 44 then"), (6, "list: Xaver Yann Zoe Ulla Tom Sven Rita Quin Paul Otto"), (7, "please convert 8 km to 3 miles"),
    ]
    df, benchmark = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(spark, df, benchmark).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (7, 1)}


def test_leaks_survive_an_inconsistent_window_of_placeholders(spark):
    item = "a train travels 9 miles and then turns back home again to rest 5 km 6 kg 5 lb 8 oz"
    text = "a train travels 7 miles and then turns back home again to rest 5 km 6 kg 9 lb 8 oz"
    df, benchmark = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontam.find_leaks(spark, df, benchmark).count() == 1
