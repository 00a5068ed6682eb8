"""Records that share an id are hashed in the order of their tie column."""

from hashlib import sha256

from scriptorium.operators import fingerprints as P


def digest(text):
    return sha256(text.encode()).hexdigest()


def test_records_of_one_id_follow_the_tie(spark):
    for first, second in (("a", "b"), ("b", "a")):
        rows = spark.createDataFrame([("k", "u", 2, second), ("k", "u", 1, first)], "k string, url string, no int, html string")
        expected = digest(digest(first) + digest(second))
        for _ in range(4):
            expected = digest(expected)
        assert P.tree_fingerprint(rows, ["k"], "url", "html", tie="no").collect()[0]["fingerprint"] == expected
