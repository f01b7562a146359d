"""Text functions, the parser, and provenance joins on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions import ontology, parser, text
from chronoweave.operators import audit, provenance, temporal
from chronoweave.operators.graph import endpoints, time_dictionary
from chronoweave.operators.graph import bucketed as with_bucket
from chronoweave.plans.graph_queries import edges
from chronoweave.plans.registry import Registry, rounded
from chronoweave.sources.fixtures import GRAPH_SQL, mentions, table

R = Registry()
_SQUEEZE = r"trim(regexp_replace({}, '[\s\p{{Z}}]+', ' ', 'g'))"


def squeeze_sql(x: str) -> str:
    return _SQUEEZE.format(x)


@R.add(f"SELECT doc_id, {squeeze_sql('text')} AS name FROM documents")
def norm_entity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.norm_entity(F.col("text")).alias("name"))


_NOT = r"[^\p{L}\p{N}_]"
_COMPANY = """names AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN p_name || ' Inc.' WHEN 1 THEN 'The ' || p_name || ' Group' WHEN 2 THEN p_name || ' Holdings, Ltd'
WHEN 3 THEN upper(p_brand) || ' & Co' WHEN 4 THEN 'The Group' ELSE p_brand END AS name FROM part)"""


def _names(spark, sf_dir):
    kind = F.pmod("p_partkey", F.lit(6))
    name = (
        F.when(kind == 0, F.concat("p_name", F.lit(" Inc.")))
        .when(kind == 1, F.concat(F.lit("The "), "p_name", F.lit(" Group")))
        .when(kind == 2, F.concat("p_name", F.lit(" Holdings, Ltd")))
        .when(kind == 3, F.concat(F.upper("p_brand"), F.lit(" & Co")))
        .when(kind == 4, F.lit("The Group"))
        .otherwise(F.col("p_brand"))
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name"))


_WORDS = "co|company|corp|corporation|group|holding|holdings|inc|limited|llc|ltd|plc|the"
_STRIP = f"regexp_replace({{}}, '(^|{_NOT.replace('{', '{{').replace('}', '}}')})(?:{_WORDS})($|{_NOT.replace('{', '{{').replace('}', '}}')})', '\\1 \\2', 'g')"
_LOW = "regexp_replace(lower(trim(name)), '[.,''\"&]', '', 'g')"
_BARE = squeeze_sql("X").replace("X", _STRIP.format(_STRIP.format(_STRIP.format(_LOW))))


@R.add(f"WITH {_COMPANY} SELECT id, CASE WHEN {_BARE} = '' THEN {_LOW} ELSE {_BARE} END AS key FROM names")
def keynorm(spark, sf_dir):
    return _names(spark, sf_dir).select("id", text.key_norm(F.col("name")).alias("key"))


_SPELLINGS = ["company", "Org-Gov", "ORG_REG", " econ ind", "Person", "loc", "alien", "ORG/GOV", "prod", "concept"]
_VERBS = ["produces", "Relate To", "impacts", "HAS", "owns", "positive impact", "member_of", "announce", "Raise", "invest in"]


def _case(expr: str, values: list[str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _map_sql(key: str, table_: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


_K = "replace(upper(trim({})), ' ', '_')"
_K2 = "replace(replace(replace(" + _K + ", '-', '/'), '_GOV', '/GOV'), '_REG', '/REG')"


@R.add(f"""WITH s AS (SELECT p_partkey AS id, {_case(f'p_partkey % {len(_SPELLINGS)}', _SPELLINGS)} AS t, {_case(f'p_partkey % {len(_VERBS)}', _VERBS)} AS r FROM part)
SELECT id, coalesce({_map_sql(_K.format('t'), ontology.TYPES_BY_KEY)}, {_map_sql(_K2.format('t'), {t.upper(): t for t in ontology.TYPE_IDS})}) AS type,
{_map_sql(_K.format('r'), ontology.RELATIONS_BY_KEY)} AS relation FROM s""")
def ontology_normalise(spark, sf_dir):
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod("p_partkey", F.lit(len(values))) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), pick(_SPELLINGS).alias("t"), pick(_VERBS).alias("r"))
    return rows.select("id", ontology.normal_type(F.col("t")).alias("type"), ontology.normal_relation(F.col("r")).alias("relation"))


_DATED = "text || ' On 2021-03-04 and Mar. 5, 2020 or 1/2/99, since 1998. ' || source || ' src'"


@R.add(rf"""WITH d AS (SELECT doc_id, {_DATED} AS b, source FROM documents),
m AS (SELECT doc_id, source, regexp_replace(regexp_replace(b, '\b(?:{text.DIGIT_DATE}|{text.NAMED_DATE})\b', '[DATE]', 'g'), '\b{text.FULL_YEAR}\b', '[YEAR]', 'g') AS b FROM d)
SELECT doc_id, md5(regexp_replace(regexp_replace(b, '(^|{_NOT})' || source || '($|{_NOT})', '\1[ENT]\2', 'g'), '(^|{_NOT})' || source || '($|{_NOT})', '\1[ENT]\2', 'g')) AS masked FROM m""")
def mask_text(spark, sf_dir):
    body = F.concat("text", F.lit(" On 2021-03-04 and Mar. 5, 2020 or 1/2/99, since 1998. "), "source", F.lit(" src"))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.mask_article(body, F.col("source")).alias("m"))
    return rows.select("doc_id", F.md5(F.col("m").cast("binary")).alias("masked"))


@R.add(r"SELECT doc_id, len(regexp_extract_all(text, '[^\s]+')) AS words, substr(text, 1, 120) AS lede FROM documents WHERE len(regexp_extract_all(text, '[^\s]+')) >= 100")
def word_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"), text.lede(F.col("text")).alias("lede"))
    return rows.where("words >= 100")


@R.add("""SELECT CASE WHEN n_chars < 200 THEN '<200' WHEN n_chars < 1000 THEN '200-1000' WHEN n_chars < 5000 THEN '1000-5000' ELSE '>=5000' END AS bin,
count(*) AS n FROM documents GROUP BY 1""")
def length_histogram(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(text.bucket_label(F.col("n_chars"), [200, 1000, 5000]).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@R.add(r"""WITH a AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '{"label": "REAL", "rationale": "x"}' WHEN 1 THEN 'I think TEMPLATE fits' WHEN 2 THEN 'none of them'
ELSE '{"label":"incoherent"}' END AS answer FROM part)
SELECT p_partkey, coalesce(nullif(upper(regexp_extract(answer, '(?i)"label"\s*:\s*"(INCOHERENT|REAL|TEMPLATE)"', 1)), ''), nullif(upper(regexp_extract(answer, '(?i)\b(INCOHERENT|REAL|TEMPLATE)\b', 1)), ''), 'PARSE_FAIL') AS label FROM a""")
def parse_label(spark, sf_dir):
    answers = ['{"label": "REAL", "rationale": "x"}', "I think TEMPLATE fits", "none of them", '{"label":"incoherent"}']
    pick = F.element_at(F.array(*[F.lit(a) for a in answers]), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.label_of(pick, ("REAL", "TEMPLATE", "INCOHERENT")).alias("label"))


def _completions(spark, sf_dir):
    """Model answers in both formats, made of orders: two triplets each, a broken one, or none."""
    h, o = F.concat(F.lit("C"), F.col("o_custkey").cast("string")), F.concat(F.lit("O"), F.col("o_orderkey").cast("string"))
    json = F.concat(F.lit('[["'), h, F.lit('","COMP","produces","'), o, F.lit('","product"],["'), h, F.lit('","COMP","Has","18.69%","CONCEPT"]]'))
    paren = F.concat(F.lit("[('"), h, F.lit("', 'COMP', 'Produce', 'U.S. "), o, F.lit(" (X)', 'COMP'), ('"), h, F.lit("', 'ALIEN', 'Has', 'B', 'COMP'"))
    raw = F.when(F.pmod("o_orderkey", F.lit(3)) == 0, json).when(F.pmod("o_orderkey", F.lit(3)) == 1, paren).otherwise("nothing")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw"))


@R.add("""SELECT o_orderkey AS id, 'C' || o_custkey AS h, 'COMP' AS h_type, 'Produce' AS r, 'O' || o_orderkey AS o, 'PRODUCT' AS o_type, true AS valid FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 'C' || o_custkey, 'COMP', 'Has', '18.69%', 'CONCEPT', false FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 'C' || o_custkey, 'COMP', 'Produce', 'U.S. O' || o_orderkey || ' (X)', 'COMP', true FROM orders WHERE o_orderkey % 3 = 1""")
def parse_triplets(spark, sf_dir):
    return parser.triplets(_completions(spark, sf_dir))


@R.add("""SELECT count(*) AS articles, count(*) FILTER (WHERE o_orderkey % 3 = 2) AS malformed, round(count(*) FILTER (WHERE o_orderkey % 3 <> 2) / count(*), 6) AS success,
round(count(*) FILTER (WHERE o_orderkey % 3 <> 2) / count(*), 6) AS mean_valid FROM orders""")
def qa_report(spark, sf_dir):
    stats = parser.extraction_stats(_completions(spark, sf_dir))
    out = stats.agg(
        F.count(F.lit(1)).alias("articles"),
        F.count_if("malformed").alias("malformed"),
        F.avg((F.col("n_valid") > 0).cast("double")).alias("success"),
        F.avg("n_valid").alias("mean_valid"),
    )
    return rounded(out, "success", "mean_valid")


@R.add("SELECT o_orderpriority AS rel, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1")
def relation_distribution(spark, sf_dir):
    from chronoweave.operators.stats import distribution

    return rounded(distribution(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("rel")), "rel"), "share")


# -- provenance: a theme is a customer nation, its members suppliers
_THEMES_SQL = """nm AS (SELECT c_nationkey AS theme, o_orderkey AS article, o_orderdate AS ts, 'C' || o_custkey AS head, 'S' || l_suppkey AS tail
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
members AS (SELECT theme, tail AS name, CAST(count(*) AS DOUBLE) AS excess FROM nm GROUP BY ALL),
th AS (SELECT theme, CAST(date_trunc('week', max(ts)) AS DATE) - 7 * (20 + theme) AS birth FROM nm GROUP BY theme),
tm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY excess DESC, name) AS place FROM members) WHERE place <= 12),
hits AS (SELECT DISTINCT tm.theme, m.article, tm.name, CAST(m.ts AS DATE) AS day, birth - 28 AS lo FROM
(SELECT article, ts, head AS name FROM mentions UNION ALL SELECT article, ts, tail FROM mentions) m JOIN tm ON tm.name = m.name JOIN th ON th.theme = tm.theme
WHERE CAST(m.ts AS DATE) BETWEEN birth - 28 AND birth + 7),
arts AS (SELECT theme, article, day, lo, count(*) AS n_members FROM hits GROUP BY ALL),
bind AS (SELECT h.*, n_members FROM hits h JOIN arts USING (theme, article) WHERE n_members >= 2),
prs AS (SELECT a.theme, a.name AS a, b.name AS b, count(*) AS joint, arg_max(a.article, (a.n_members, -a.article)) AS best FROM bind a JOIN bind b ON a.theme = b.theme AND a.article = b.article AND a.name < b.name GROUP BY ALL)"""
_PROV = f"WITH {GRAPH_SQL}, {_THEMES_SQL}"


def _theme_tables(spark, sf_dir):
    rows = mentions(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("head"), F.col("c_nationkey").alias("theme"))
    own = rows.join(customers, "head")
    members = own.groupBy("theme", F.col("tail").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("excess"))
    last = own.groupBy("theme").agg(F.date_trunc("week", F.max("ts")).cast("date").alias("last"))
    themes = last.select("theme", F.date_sub("last", 7 * (20 + F.col("theme"))).alias("birth"))
    return rows, themes, members


def _hits(spark, sf_dir):
    rows, themes, members = _theme_tables(spark, sf_dir)
    return provenance.member_hits(rows, themes, members), themes, members


@R.add(f"{_PROV} SELECT theme, name, excess, place FROM tm")
def top_members(spark, sf_dir):
    return provenance.top_members(_theme_tables(spark, sf_dir)[2])


@R.add(f"{_PROV} SELECT theme, article, name, day, lo FROM hits")
def mention_range_join(spark, sf_dir):
    return _hits(spark, sf_dir)[0]


@R.add(f"""{_PROV} SELECT theme, article, day, lo, n_members, place FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY n_members DESC, abs(day - lo), article) AS place FROM arts) WHERE place <= 10""")
def top_articles(spark, sf_dir):
    return provenance.top_articles(_hits(spark, sf_dir)[0])


@R.add(f"""{_PROV} SELECT theme, a, b, joint, best, place FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY joint DESC, a, b) AS place FROM prs) WHERE place <= 8""")
def top_pairs(spark, sf_dir):
    return provenance.top_pairs(_hits(spark, sf_dir)[0])


@R.add(f"""{_PROV}, s AS (SELECT theme, count(*) AS size FROM tm GROUP BY theme), j AS (SELECT theme, count(*) AS n_binding, avg((n_members >= 3)::INT) AS multi3_share, avg(n_members) AS mean_members FROM arts WHERE n_members >= 2 GROUP BY theme),
p AS (SELECT theme, count(*) AS pairs FROM prs GROUP BY theme)
SELECT s.theme, coalesce(n_binding, 0) AS n_binding, round(coalesce(multi3_share, 0), 6) AS multi3_share, round(CASE WHEN size > 1 THEN coalesce(pairs, 0) / (size * (size - 1) / 2) ELSE 0 END, 6) AS pair_coverage,
round(coalesce(mean_members, 0), 6) AS mean_members FROM s LEFT JOIN j USING (theme) LEFT JOIN p USING (theme)""")
def cohesion_stats(spark, sf_dir):
    hits, themes, members = _hits(spark, sf_dir)
    return rounded(provenance.cohesion(hits, themes, members), "multi3_share", "pair_coverage", "mean_members")


@R.add()
def audit_packs(spark, sf_dir):
    hits, themes, members = _hits(spark, sf_dir)
    titles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article"), F.col("o_orderpriority").alias("title"))
    return provenance.packs(hits, themes, members, titles)


@R.add(f"""{_PROV}, fw AS (SELECT ent, min(time) AS first FROM both_ends GROUP BY ent)
SELECT tm.theme, round(avg(CASE WHEN (200 + tm.theme) - first BETWEEN 0 AND 13 THEN 1.0 ELSE 0.0 END), 6) AS debut_share FROM tm LEFT JOIN fw ON ent = name GROUP BY tm.theme""")
def debut_share(spark, sf_dir):
    _, themes, members = _theme_tables(spark, sf_dir)
    first = temporal.entity_weeks(edges(spark, sf_dir)).groupBy("ent").agg(F.min("time").alias("first"))
    return rounded(provenance.debut_share(members, themes.select("theme", (200 + F.col("theme")).alias("birth_week")), first), "debut_share")


@R.add(f"""WITH {GRAPH_SQL}, ev(name, event) AS (VALUES ('a', DATE '1995-03-05'), ('b', DATE '1996-07-04'), ('c', DATE '1990-01-01'), ('d', DATE '2030-01-01'), ('e', DATE '1997-02-06'))
SELECT name, event, arg_min(time, (abs(event - bucket), time)) AS time FROM ev, times GROUP BY name, event""")
def nearest_bucket_asof(spark, sf_dir):
    days = [("a", "1995-03-05"), ("b", "1996-07-04"), ("c", "1990-01-01"), ("d", "2030-01-01"), ("e", "1997-02-06")]
    events = spark.createDataFrame(days, "name string, event string").withColumn("event", F.col("event").cast("date"))
    return provenance.nearest_bucket(events, time_dictionary(with_bucket(mentions(spark, sf_dir))))


@R.add(f"""WITH {GRAPH_SQL}, tot AS (SELECT ent, count(*) AS total FROM (SELECT subj AS ent FROM edges UNION ALL SELECT obj FROM edges) GROUP BY ent),
w(name) AS (VALUES ('C12'), ('s9'), ('S1'), ('zz'))
SELECT name, ent FROM (SELECT name, ent, row_number() OVER (PARTITION BY name ORDER BY ent = name DESC, total DESC, ent) AS k FROM w JOIN tot ON ent = name OR contains(lower(ent), lower(name))) WHERE k = 1""")
def find_entities(spark, sf_dir):
    totals = endpoints(edges(spark, sf_dir)).groupBy("ent").agg(F.count(F.lit(1)).alias("total"))
    return provenance.find_entities(spark.createDataFrame([("C12",), ("s9",), ("S1",), ("zz",)], "name string"), totals)


@R.add(r"""SELECT conv_id, turn, replace('Read: <text>!', '<text>', substr(coalesce(text, ''), 1, 6000)) AS prompt FROM conversations""")
def build_prompts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.prompt("Read: <text>!", F.col("text")).alias("prompt"))




# -- audit
@R.add(f"""{_PROV}, r AS (SELECT theme, bool_or(name IN ('S7')) AS noise, bool_or(name IN ('S8', 'S9')) AS rl FROM tm GROUP BY theme),
s AS (SELECT theme FROM (SELECT DISTINCT theme FROM tm) ORDER BY md5('42|' || theme), theme LIMIT 6)
SELECT r.theme, CASE WHEN noise THEN 'control_noise' WHEN rl THEN 'control_real' ELSE 'sample' END AS role FROM r LEFT JOIN s ON s.theme = r.theme WHERE noise OR rl OR s.theme IS NOT NULL""")
def review_sheet(spark, sf_dir):
    members = provenance.top_members(_theme_tables(spark, sf_dir)[2])
    return audit.review_sheet(members, ["S8", "S9"], ["S7"], 6)



_SPLIT_SQL = """mem AS (SELECT DISTINCT theme AS id, name AS member FROM tm), sz AS (SELECT id, count(*) AS size FROM mem GROUP BY id),
lk AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM mem a JOIN mem b ON a.member = b.member AND a.id < b.id GROUP BY ALL),
ln AS (SELECT a, b FROM lk JOIN sz x ON x.id = a JOIN sz y ON y.id = b WHERE shared / (x.size + y.size - shared) >= 0.3),
both_ways AS (SELECT a, b FROM ln UNION SELECT b, a FROM ln),
rc AS (SELECT id AS node, id AS reached FROM sz UNION SELECT rc.node, e.b FROM rc JOIN both_ways e ON e.a = rc.reached),
cc AS (SELECT node, min(reached) AS grp FROM rc GROUP BY node)"""


@R.add(f"""WITH RECURSIVE {GRAPH_SQL}, {_THEMES_SQL}, {_SPLIT_SQL}
SELECT CAST(node AS BIGINT) AS id, CAST(grp AS BIGINT) AS "group", bool_or(birth >= DATE '2001-01-01') OVER (PARTITION BY grp) AS is_test FROM cc JOIN th ON th.theme = node""")
def distillation_split(spark, sf_dir):
    _, themes, members = _theme_tables(spark, sf_dir)
    packs = provenance.top_members(members).select(F.col("theme").cast("long").alias("id"), F.col("name").alias("member"))
    births = themes.select(F.col("theme").cast("long").alias("id"), "birth")
    return audit.distillation_split(packs, births, F.lit("2001-01-01").cast("date"))


@R.add("""SELECT unnest(['PERSON', 'GPE', 'EVENT', 'SECTOR', 'ORG/GOV', 'ORG/REG', 'ORG', 'ECON_INDICATOR', 'FIN_INSTRUMENT', 'CONCEPT']) AS type""")
def missing_types(spark, sf_dir):
    return audit.missing_types(parser.triplets(_completions(spark, sf_dir)))


@R.add()
def judge_prompts(spark, sf_dir):
    from chronoweave.sources.readers import PACK

    hits, themes, members = _hits(spark, sf_dir)
    titles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article"), F.col("o_orderpriority").alias("title"))
    packs = provenance.packs(hits, themes, members, titles)
    return audit.rendered(packs.select(F.from_json("pack", PACK).alias("p")).select("p.*"))
