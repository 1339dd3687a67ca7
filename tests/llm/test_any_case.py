"""Benchmark items in another case, and items shorter than a window."""

from partwise.llm import decontaminate

ITEM = ("On the market square Anna sold her pears to Boris while Clara counted the coins that Dmitri and later "
        "Elena had left beside the old scales of Farid before noon on the last day of harvest.")


def test_copies_in_any_case_and_short_items(spark):
    items = spark.createDataFrame([(1, ITEM), (2, "Quagga zeppelin"), (3, ""), (4, None)], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "so " + ITEM.lower() + " it was"), (2, ITEM.upper()), (3, ITEM), (4, "a QUAGGA zeppelin, seen"), (5, "Quagga"),
        (6, "zeppelin quagga"), (7, " ".join(reversed(ITEM.split()))), (8, None), (9, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 2)}
    assert {r["doc_id"] for r in decontaminate.drop_leaked(docs, items).collect()} == {5, 6, 7, 8, 9}
