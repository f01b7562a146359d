import pytest
from pyspark.sql import functions as F

from chronoweave.functions import ontology, parser, text


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s"))).first()[0]


@pytest.mark.parametrize(
    ("name", "key"),
    [("Apple Inc.", "apple"), ("The Group", "the group"), ("Co", "co"), ("Johnson & Johnson", "johnson johnson"),
     ("Alibaba Group Holding", "alibaba"), ("Coé Ltd", "coé"), ("  A.B.,'C' Corp ", "abc")],
)
def test_key_norm(spark, name, key):
    assert one(spark, text.key_norm, name) == key


@pytest.mark.parametrize(
    ("title", "skeleton"),
    [("AAPL, MSFT rise 3.5% on March 1st", "@t @t rise @n on @m @n"), ("Café IPO", "café @t"), ("ÉCOLE A B C", "école @t @t @t"), ("TOOLONG x", "toolong x")],
)
def test_slot_norm(spark, title, skeleton):
    assert one(spark, text.slot_norm, title) == skeleton


@pytest.mark.parametrize(("value", "n"), [("", 0), (None, 0), ("  ", 0), (" a  b\nc ", 3)])
def test_word_count(spark, value, n):
    assert one(spark, text.word_count, value) == n


def test_masks(spark):
    rows = spark.createDataFrame([("On 2021-03-04 AAPL and Aapl's AAPLX fell, Mar. 5, 2020; in 1998 Tim.Cook spoke", "AAPL", ["Tim.Cook", "of"])], "b string, t string, n array<string>")
    got = rows.select(text.mask_article(F.col("b"), F.col("t"), F.col("n"))).first()[0]
    assert got == "On [DATE] [ENT] and Aapl's AAPLX fell, [DATE]; in [YEAR] [ENT] spoke"
    rows = spark.createDataFrame([("Alpha Beta and alpha (x)", ["Alpha", "Alpha Beta", "(x)", "ab"])], "b string, e array<string>")
    assert rows.select(text.mask_entities(F.col("b"), F.col("e"))).first()[0] == "[ENT0] and [ENT1] [ENT2]"


def test_small_functions(spark):
    assert one(spark, lambda c: text.label_of(c, ("REAL", "TEMPLATE")), '{"label": "real"}') == "REAL"
    assert one(spark, lambda c: text.label_of(c, ("REAL", "TEMPLATE")), "really TEMPLATE") == "TEMPLATE"
    assert one(spark, lambda c: text.label_of(c, ("REAL",)), "?") == "PARSE_FAIL"
    assert one(spark, text.is_numeric, "$125.00") and one(spark, text.is_numeric, "18.69%") and not one(spark, text.is_numeric, "3M")
    assert one(spark, text.is_brand, "The Motley  Fool") and not one(spark, text.is_brand, "Zacksy")
    assert one(spark, lambda c: text.duration(c.cast("int")), "7384") == "2h03m"
    assert one(spark, lambda c: text.prompt("<text>|<text>", c, 3), "abcdef") == "abc|abc"
    assert one(spark, lambda c: text.norm_entity(c, {"us": "United States"}), "  US ") == "United States"


@pytest.mark.parametrize(("raw", "want"), [("company", "COMP"), ("ORG-GOV", "ORG/GOV"), ("org_reg", "ORG/REG"), ("econ ind", "ECON_INDICATOR"), ("ALIEN", None), (None, None), ("", None)])
def test_types(spark, raw, want):
    assert one(spark, ontology.normal_type, raw) == want


def test_vocabulary_sizes():
    assert len(ontology.TYPE_IDS) == 12 and len(ontology.RELATION_IDS) == 15 and len(ontology.TYPES_BY_KEY) == 30 and len(ontology.RELATIONS_BY_KEY) == 32


PARSED = [
    ('[["Apple","COMP","Introduce","iPhone","PRODUCT"]]', [("Apple", "COMP", "Introduce", "iPhone", "PRODUCT", True)]),
    ("[('Apple', 'COMP', 'Produce', 'U.S. Steel (X)', 'COMP')]", [("Apple", "COMP", "Produce", "U.S. Steel (X)", "COMP", True)]),
    ("('Apple', 'COMP', 'Positive_Impact_On', 'Apple's Value', 'FIN_INSTRUMENT')", [("Apple", "COMP", "Positive_Impact_On", "Apple's Value", "FIN_INSTRUMENT", True)]),
    ('[["A1","company","produces","B1","prod"]]', [("A1", "COMP", "Produce", "B1", "PRODUCT", True)]),
    ('[["A1","COMP","Has","18.69%","CONCEPT"]]', [("A1", "COMP", "Has", "18.69%", "CONCEPT", False)]),
    ('[["A1","ALIEN","Has","B1","COMP"]]', [("A1", "ALIEN", "Has", "B1", "COMP", False)]),
    ('[["A1","COMP","Has","B1","COMP"],["C1","COMP","Has', [("A1", "COMP", "Has", "B1", "COMP", True)]),
    ('[["A","COMP","Has","B","COMP"]] (\'C\', \'COMP\', \'Has\', \'D\', \'COMP\')', [("A", "COMP", "Has", "B", "COMP", True)]),
    ('[["say \\"hi\\"","COMP",\n"Has","B","COMP"]]', [('say "hi"', "COMP", "Has", "B", "COMP", True)]),
    ("", []),
    (None, []),
    ("[[\"\",\"COMP\",\"Has\",\"B\",\"COMP\"]]", []),
]


def test_parser_goldens(spark):
    rows = spark.createDataFrame([(k, raw) for k, (raw, _) in enumerate(PARSED)], "id int, raw string")
    got = {k: [] for k in range(len(PARSED))}
    for r in parser.triplets(rows).collect():
        got[r.id].append(tuple(r)[1:])
    assert got == {k: want for k, (_, want) in enumerate(PARSED)}
    stats = {r.id: r for r in parser.extraction_stats(rows).collect()}
    assert stats[9].malformed and stats[10].malformed and not stats[5].malformed and stats[5].n_valid == 0


def test_a_model_is_called_in_batches(spark):
    prompts = spark.createDataFrame([(k, f"p{k}") for k in range(5)], "id int, prompt string")
    got = parser.complete(prompts, lambda: lambda batch: [p.upper() for p in batch])
    assert {(r.id, r.raw) for r in got.collect()} == {(k, f"P{k}") for k in range(5)}
