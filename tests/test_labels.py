from bidlake.functions import documents as D


def test_labels_without_an_equal_word_are_scored(spark):
    labels = spark.createDataFrame([("Telephne",), ("Emailaddress",), ("Telephone",), ("Zzz",), (None,)], "label string")
    aliases = spark.createDataFrame([("Telephone", "phone", 1), ("E-mail address", "email", 2)], "alias string, canonical string, position int")
    got = {r["key"]: (r["canonical"], r["status"]) for r in D.match_labels_fuzzy(labels, aliases).collect()}
    assert got["telephne"] == ("phone", "matched") and got["emailaddress"][0] == "email" and got["telephone"] == ("phone", "matched")
    assert got["zzz"][1] == "unmatched" and got.get(None, (None, "unmatched")) == (None, "unmatched")
    assert D.match_labels_fuzzy(labels, aliases.limit(0)).where("status != 'unmatched'").count() == 0
