"""The fixed vocabulary: 12 entity types and 15 relations with ids, spellings that stand for them, normalisers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPES = "PERSON|GPE|COMP|EVENT|PRODUCT|SECTOR|ORG/GOV|ORG/REG|ORG|ECON_INDICATOR|FIN_INSTRUMENT|CONCEPT"
TYPE_IDS = {name: i for i, name in enumerate(_TYPES.split("|"))}
_RELATIONS = (
    "Relate_To|Control|Operate_In|Impact|Has|Negative_Impact_On|Raise|Is_Member_Of|Participates_In|Announce|Invests_In"
    "|Produce|Introduce|Decrease|Positive_Impact_On"
)
RELATION_IDS = {name: i for i, name in enumerate(_RELATIONS.split("|"))}
IMPACT = tuple("Decrease Impact Negative_Impact_On Positive_Impact_On Raise".split())

_SPELT_TYPES = {
    "COMP": "COMPANY COMPANIES",
    "CONCEPT": "",
    "ECON_INDICATOR": "ECONOMIC_INDICATOR ECON_IND ECON_INDICATORS",
    "FIN_INSTRUMENT": "FINANCIAL_INSTRUMENT FIN_INST FIN_INSTRUMENTS",
    "GPE": "LOC LOCATION",
    "ORG": "ORGANISATION ORGANIZATION",
    "ORG/GOV": "GOV ORG/GOVERNMENT",
    "ORG/REG": "REG ORG/REGULATOR",
    "PERSON": "PER",
    "PRODUCT": "PROD",
}
_SPELT_RELATIONS = {
    "Announce": "ANNOUNCES",
    "Control": "CONTROLS",
    "Decrease": "DECREASES",
    "Impact": "IMPACTS",
    "Introduce": "INTRODUCES",
    "Invests_In": "INVEST_IN",
    "Is_Member_Of": "MEMBER_OF",
    "Negative_Impact_On": "NEGATIVELY_IMPACT NEGATIVE_IMPACT",
    "Operate_In": "OPERATES_IN",
    "Participates_In": "PARTICIPATE_IN",
    "Positive_Impact_On": "POSITIVELY_IMPACT POSITIVE_IMPACT",
    "Produce": "PRODUCES",
    "Raise": "RAISES",
    "Relate_To": "RELATED_TO RELATES_TO",
}
TYPES_BY_KEY = {t.upper(): t for t in TYPE_IDS} | {a: t for t, names in _SPELT_TYPES.items() for a in names.split()}
RELATIONS_BY_KEY = {r.upper(): r for r in RELATION_IDS} | {
    a: r for r, names in _SPELT_RELATIONS.items() for a in names.split()
}


def _table(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _key(s: Column) -> Column:
    return F.translate(F.upper(F.trim(s)), " ", "_")


def normal_type(s: Column) -> Column:
    """The canonical type, also from ORG-GOV or ORG_GOV spellings; null if there is none."""
    known = _table(TYPES_BY_KEY)
    again = F.replace(F.replace(F.translate(_key(s), "-", "/"), F.lit("_GOV"), F.lit("/GOV")), F.lit("_REG"), F.lit("/REG"))
    canonical = _table({t.upper(): t for t in TYPE_IDS})
    return F.coalesce(F.element_at(known, _key(s)), F.element_at(canonical, again))


def normal_relation(s: Column) -> Column:
    return F.element_at(_table(RELATIONS_BY_KEY), _key(s))


def type_id(s: Column) -> Column:
    return F.element_at(_table(TYPE_IDS), s)


def relation_id(s: Column) -> Column:
    return F.element_at(_table(RELATION_IDS), s)
