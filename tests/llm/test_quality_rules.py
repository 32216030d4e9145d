"""The outlier verdict on one statistic."""
from presswork.llm import quality_rules


def test_symbols_alone_reject(spark):
    def text(i, bars):
        words = [f"word{(i * 37 + k * 11) % 5003}" for k in range(80 + i % 20)]
        for k in range(bars):
            words.insert(k * 2, "|" * 6)
        return " ".join(words)

    rows = [(i, text(i, 12 if i == 5 else 0), "en", "a") for i in range(200)]
    found = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert [r["doc_id"] for r in found.filter("not kept").collect()] == [5]
