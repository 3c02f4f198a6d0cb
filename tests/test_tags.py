import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravet.functions.tags import Rule, Rules, Selector, SelectorError, merged

TAGS = T.StructType([T.StructField("tags", T.MapType(T.StringType(), T.StringType()))])


def matched(spark, rules, tags, extra=False):
    df = spark.createDataFrame([(tags,)], TAGS)
    c = rules.matches_with_extra(F.col("tags")) if extra else rules.matches(F.col("tags"))
    return df.select(c.alias("m")).first()["m"]


@pytest.mark.parametrize(
    ("selector", "tags", "expected"),
    [
        ("[p]", {"p": "+48"}, ["[p]"]),
        ('[p="+48"]', {"p": "+48"}, ['[p="+48"]']),
        ('[p="+48"]', {"p": "+4"}, []),
        ("[p~4]", {"p": "+48"}, ["[p~4]"]),
        ("[p~5]", {"p": "+48"}, []),
        ("[highway=footway][footway=traffic_island]", {"highway": "footway"}, []),
        ("[highway=footway][footway=traffic_island]", {"highway": "footway", "footway": "traffic_island"}, ["[footway=traffic_island][highway=footway]"]),
        ("[highway=footway][!footway]", {"highway": "footway"}, ["[!footway][highway=footway]"]),
        ("[highway=footway][!footway]", {"highway": "footway", "footway": "traffic_island"}, []),
        ("[highway][highway!=no]", {"highway": "no"}, []),
        ("[highway][highway!=no]", {"highway": "primary"}, ["[highway][highway!=no]"]),
    ],
)
def test_match(spark, selector, tags, expected):
    assert matched(spark, Rules((Rule.of(selector),)), tags) == expected


def test_several_rules_and_interest(spark):
    rules = Rules((Rule.of('[amenity~".*"]'), Rule.of("[shop=florist]")))
    assert matched(spark, rules, {"shop": "florist", "phone": "+48"}) == ["[shop=florist]"]
    assert matched(spark, rules, {"shop": "fish"}) == []
    assert matched(spark, rules, {"amenity": "pole"}) == ['[amenity~".*"]']
    florist = Rules((Rule.of("[shop=florist]", interest=("phone",)),))
    assert matched(spark, florist, {"shop": "florist", "phone": "+2", "fax": "forgot"}, extra=True) == ["[shop=florist]", "phone", "shop"]


def test_changed_needs_a_key_of_interest(spark):
    rules = Rules((Rule.of("[shop=florist]", interest=("phone",)),))
    schema = "b map<string,string>, a map<string,string>"
    rows = [({"shop": "florist"}, {"shop": "florist", "fax": "1"}), ({"shop": "florist"}, {"shop": "florist", "phone": "1"}), ({"shop": "fish"}, {"shop": "fish", "phone": "1"}), (None, {"shop": "florist"})]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(rules.changed(F.col("b"), F.col("a"))).collect()]
    assert got == [False, True, False, True]


def test_no_rules_select_everything_and_null_tags_nothing(spark):
    df = spark.createDataFrame([(None,)], TAGS)
    assert df.select(Rules().predicate(F.col("tags"))).first()[0] is True
    assert df.select(Rules((Rule.of("[a]"),)).predicate(F.col("tags"))).first()[0] is False


@pytest.mark.parametrize("bad", ["", "a=b", "[a", "[=b]", "[a=]", "[!a=b]"])
def test_bad_selectors(bad):
    with pytest.raises(SelectorError):
        Selector.parse(bad)


def test_merged_rules_join_sources_and_groups():
    one = merged([Rule.of("[a]", sources=("x",), user_groups=("g",)), Rule.of("[a]", sources=("y",), user_groups=("h",)), Rule.of("[b]")])
    assert len(one.rules) == 2
    assert one.rules[0].sources == ("x", "y") and one.rules[0].user_groups == ("g", "h")
