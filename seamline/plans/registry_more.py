"""Queries of the results table, text functions, model evaluation, sampling and simulation."""

from __future__ import annotations

import hmac

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.functions import ball
from seamline.functions import text as tx
from seamline.operators import aggregate as ag
from seamline.operators import boosting as bo
from seamline.operators import models as mo
from seamline.operators import rates as ra
from seamline.operators import results as re_
from seamline.operators import simulate as si
from seamline.operators import windows as wi
from seamline.operators.scan import in_order, numbered
from seamline.plans import views as v
from seamline.plans.registry import QUERIES, _COUNTS, _POOL, _STATS, E, L, _counts, _pool, ex, lx, query
from seamline.session import scratch, ship, written
from seamline.sources import ingest, loader, remote


def _rows(s: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return s.createDataFrame(rows, ddl)


def _q(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _values(rows: list[tuple], columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_q, r)) + ')' for r in rows)}) t({columns})"


# -- results


@query("S16_insert_runs", E("""
, ol AS (SELECT * FROM runs WHERE date < '2024-01-10'), nw AS (SELECT * REPLACE (CASE WHEN date >= '2024-01-20' THEN '2024-01-09' ELSE date END AS date) FROM runs WHERE date >= '2024-01-08'),
 a AS (SELECT * FROM nw WHERE id NOT IN (SELECT id FROM ol)), f AS (SELECT *, row_number() OVER (PARTITION BY date, CASE WHEN trim(player) <> '' THEN player ELSE concat(chr(0), id) END ORDER BY finished_at, id) AS rn FROM a),
 k AS (SELECT * FROM f WHERE rn = 1 AND (trim(player) = '' OR NOT EXISTS (SELECT 1 FROM ol WHERE ol.date = f.date AND ol.player = f.player)))
 SELECT id, date, player, total_score FROM ol UNION ALL SELECT id, date, player, total_score FROM k"""))
def insert_runs(s: SparkSession, d: str) -> DataFrame:
    r = v.results(s, d)
    new = r.where("date >= '2024-01-08'").withColumn("date", F.when(F.col("date") >= "2024-01-20", "2024-01-09").otherwise(F.col("date")))
    return re_.insert_runs(r.where("date < '2024-01-10'"), new).select("id", "date", "player", "total_score")


@query("S17_set_player", E(" SELECT id, CASE WHEN id = (SELECT min(id) FROM runs) THEN 'Renamed' ELSE player END AS player FROM runs"))
def set_player(s: SparkSession, d: str) -> DataFrame:
    r = v.results(s, d)
    return re_.set_player(r, r.agg(F.min("id")).first()[0], "Renamed").select("id", "player")


@query("J10_merged_attributes", "WITH m AS (SELECT c_custkey::BIGINT AS player, 'RHB' AS value FROM customer WHERE c_custkey % 5 = 0), s AS (SELECT c_custkey::BIGINT AS player, 'LHB' AS value FROM customer WHERE c_custkey % 3 = 0) SELECT coalesce(m.player, s.player) AS player, coalesce(m.value, s.value) AS value, CASE WHEN m.value IS NOT NULL THEN 'manual' ELSE 'sourced' END AS provenance FROM m FULL JOIN s ON m.player = s.player")
def merged(s: SparkSession, d: str) -> DataFrame:
    c = v.table(s, d, "customer").select(F.col("c_custkey").cast("bigint").alias("player"))
    return re_.merged_attributes(c.where("player % 5 = 0").withColumn("value", F.lit("RHB")), c.where("player % 3 = 0").withColumn("value", F.lit("LHB")))


_GATE = "WITH b AS (SELECT year(o_orderdate)::VARCHAR AS key, CASE year(o_orderdate) % 3 WHEN 0 THEN 'count' WHEN 1 THEN 'fault' ELSE 'coverage' END AS kind, count(*)::DOUBLE AS value FROM orders GROUP BY ALL), r AS (SELECT key, kind, value + (CASE key WHEN '1998' THEN -1 WHEN '1999' THEN 1 WHEN '1996' THEN 2 WHEN '1997' THEN -0.001 ELSE -0.004 END)::DOUBLE AS value FROM b WHERE key <> '1995')"


@query("J11_B17_quality_gate", _GATE + """ SELECT * FROM (SELECT coalesce(b.key, r.key) AS key, coalesce(b.kind, r.kind) AS kind, b.value AS was, r.value AS now,
 CASE WHEN b.value IS NULL THEN NULL WHEN r.value IS NULL THEN 'missing' WHEN b.kind = 'coverage' AND r.value < b.value - 0.005 THEN 'coverage fell' WHEN b.kind = 'count' AND r.value < b.value THEN 'fewer' WHEN b.kind = 'fault' AND r.value > b.value THEN 'more faults' END AS regression
 FROM b FULL JOIN r ON b.key = r.key AND b.kind = r.kind) t WHERE regression IS NOT NULL""")
def gate(s: SparkSession, d: str) -> DataFrame:
    y = F.year("o_orderdate")
    b = v.table(s, d, "orders").groupBy(y.cast("string").alias("key"), F.when(y % 3 == 0, "count").when(y % 3 == 1, "fault").otherwise("coverage").alias("kind")).agg(F.count("*").cast("double").alias("value"))
    shift = F.when(F.col("key") == "1998", -1.0).when(F.col("key") == "1999", 1.0).when(F.col("key") == "1996", 2.0).when(F.col("key") == "1997", -0.001).otherwise(-0.004)
    return re_.compare_reports(b, b.where("key != '1995'").withColumn("value", F.col("value") + shift))


@query("J13_squad_check", "WITH s AS (SELECT s_suppkey AS player, 8 + s_suppkey % 5 AS cost FROM supplier WHERE s_suppkey IN (1, 2, 3, 4)) SELECT CASE WHEN count(*) <> 4 THEN 'wrong number' WHEN sum(cost) > 38 THEN 'over budget' END AS broken, count(*) AS n, sum(cost)::BIGINT AS total FROM s")
def squad(s: SparkSession, d: str) -> DataFrame:
    pool = v.table(s, d, "supplier").selectExpr("cast(s_suppkey as bigint) AS player", "8 + s_suppkey % 5 AS cost")
    return re_.squad_check(_rows(s, [(1,), (2,), (3,), (4,)], "player bigint"), pool, 4, 38)


@query("J14_U5_F22_draw", f"WITH p AS ({_POOL}) SELECT player, economy, is_spin FROM p WHERE player NOT IN (SELECT player FROM p WHERE player % 10 = 0) ORDER BY sha256('day-1|' || player::VARCHAR), player LIMIT 11")
def draw(s: SparkSession, d: str) -> DataFrame:
    p = _pool(s, d)
    return re_.draw(p, "day-1", 11, p.where("player % 10 = 0"))


@query("J4_registry_join", "SELECT d.conv_id, d.role, count(*) AS n, count(r.id) AS resolved FROM (SELECT conv_id, turn, role FROM conversations) d LEFT JOIN (SELECT DISTINCT conv_id, role, concat(role, '-', conv_id) AS id FROM conversations WHERE turn < 1) r ON r.conv_id = d.conv_id AND r.role = d.role GROUP BY ALL")
def registry_join(s: SparkSession, d: str) -> DataFrame:
    c = v.table(s, d, "conversations").select("conv_id", "turn", "role")
    names = c.where("turn < 1").select("conv_id", "role", F.concat_ws("-", "role", F.col("conv_id").cast("string")).alias("id")).distinct()
    return c.join(names, ["conv_id", "role"], "left").groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.count("id").alias("resolved"))


@query("J12_aliases", "SELECT n_name AS name, CASE lower(trim(n_name)) WHEN 'india' THEN 'Bharat' WHEN 'germany' THEN 'Deutschland' ELSE n_name END AS canonical, count(*) AS n FROM nation GROUP BY ALL")
def aliases(s: SparkSession, d: str) -> DataFrame:
    n = v.table(s, d, "nation")
    return n.groupBy(F.col("n_name").alias("name"), tx.canonical(F.col("n_name"), {"INDIA": "Bharat", "Germany": "Deutschland"}, fold=True).alias("canonical")).agg(F.count("*").alias("n"))


# -- sources and sinks


@query("S5_S6_S7_facts_round_trip", E(" SELECT delivery_id, innings_id, season, over, batter, bowler, runs_bat, wicket FROM d"))
def round_trip(s: SparkSession, d: str) -> DataFrame:
    x, path = v.ordered(s, d), scratch(s)
    ingest.write_facts(x, path)
    ingest.verify_round_trip(x, path)
    return ingest.read_facts(s, path, x.schema).select("delivery_id", "innings_id", "season", "over", "batter", "bowler", "runs_bat", "wicket")


@query("S2_source_order", "SELECT o_orderkey::BIGINT AS key, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS match_id FROM orders")
def source_order(s: SparkSession, d: str) -> DataFrame:
    return numbered(v.table(s, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("key"), "o_orderdate"), "o_orderdate", "key", name="match_id").select("key", "match_id")


@query("S4_nested_explode", "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INT AS pos, role FROM conversations")
def nested(s: SparkSession, d: str) -> DataFrame:
    c = v.table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return c.select("conv_id", F.posexplode("turns").alias("pos", "t")).select("conv_id", "pos", "t.role")


def _documents(x: DataFrame) -> DataFrame:
    """(day, doc): a match document for each match of ``x``, as the readers of sources expect it."""
    name = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("P"), F.col(c).cast("string")))
    ball = F.struct(
        name("batter").alias("batter"), name("bowler").alias("bowler"), name("non_striker").alias("non_striker"), F.struct(F.col("runs_bat").alias("batter")).alias("runs"),
        F.struct("wides", "noballs", "byes", "legbyes", "penalty").alias("extras"), F.when(F.col("wicket").isNotNull(), F.array(F.struct(F.col("wicket").alias("kind"), name("player_out").alias("player_out")))).alias("wickets"),
    )
    nested = lambda df, keys, order, value, alias: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda e: e["v"]).alias(alias))
    overs = nested(x, ["match_id", "innings_id", "super_over", "over"], "delivery_id", ball, "deliveries")
    inns = nested(overs, ["match_id", "innings_id", "super_over"], "over", F.struct("over", "deliveries"), "overs")
    matches = nested(inns, ["match_id"], "innings_id", F.struct(F.lit("A").alias("team"), "super_over", "overs"), "innings")
    seen = x.select("match_id", F.explode(F.array("batter", "bowler", "non_striker")).alias("p")).distinct()
    people = seen.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("P"), F.col("p").cast("string")), F.concat(F.lit("id"), F.col("p").cast("string"))))).alias("people"))
    day = F.date_format(F.date_add(F.lit("2008-01-01").cast("date"), F.col("match_id").cast("int")), "yyyy-MM-dd")
    info = F.struct(F.array(day).alias("dates"), F.array(F.lit("A"), F.lit("B")).alias("teams"), F.lit("Ground").alias("venue"), F.struct("people").alias("registry"))
    return matches.join(people, "match_id").select(day.alias("day"), F.to_json(F.struct(info.alias("info"), "innings")).alias("doc"))


@query("S1_S3_S4_J4_P7_ingest", E("""
, p AS (SELECT DISTINCT unnest([batter, bowler, non_striker]) AS p FROM d), r AS (SELECT p, (dense_rank() OVER (ORDER BY concat('id', p)) - 1)::INT AS player_id FROM p),
 m AS (SELECT match_id, (row_number() OVER (ORDER BY match_id) - 1)::INT AS no FROM (SELECT DISTINCT match_id FROM d)), i AS (SELECT match_id, innings_id, (row_number() OVER (PARTITION BY match_id ORDER BY innings_id) - 1)::INT AS inn FROM (SELECT DISTINCT match_id, innings_id FROM d))
 SELECT m.no AS match_id, (m.no * 8 + i.inn)::BIGINT AS innings_id, over, (row_number() OVER (PARTITION BY d.innings_id, super_over, over ORDER BY delivery_id) - 1)::INT AS ball_in_over, b.player_id AS batter, w.player_id AS bowler, n.player_id AS non_striker, o.player_id AS player_out, runs_bat, wides, noballs, byes, legbyes, wicket
 FROM d JOIN m ON m.match_id = d.match_id JOIN i ON i.innings_id = d.innings_id LEFT JOIN r b ON b.p = batter LEFT JOIN r w ON w.p = bowler LEFT JOIN r n ON n.p = non_striker LEFT JOIN r o ON o.p = player_out"""))
def ingest_documents(s: SparkSession, d: str) -> DataFrame:
    root = scratch(s)
    x = v.ordered(s, d)
    # a document a file, all in one folder of the readers' pattern
    _documents(x).write.partitionBy("day").text(f"{root}/matches.json")
    everyone = x.select(F.explode(F.array("batter", "bowler", "non_striker")).alias("p")).distinct()
    everyone.selectExpr("concat('id', p) AS identifier", "concat('P', p) AS name", "concat('Player ', p) AS unique_name", "p AS key_cricinfo").write.option("header", True).csv(f"{root}/register.csv")
    m = ingest.read_matches(s, root)
    seen = ingest.people(m)
    players = ingest.resolve_players(seen, ingest.read_register(s, f"{root}/register.csv"))
    got = ingest.with_player_ids(ingest.deliveries(m), seen, players)
    return got.select("match_id", "innings_id", "over", "ball_in_over", "batter", "bowler", "non_striker", "player_out", "runs_bat", "wides", "noballs", "byes", "legbyes", "wicket")


@query("S8_S9_attributes", "SELECT concat('id', s_suppkey) AS person_id, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'RHB' WHEN 1 THEN 'LHB' END AS batting_hand, 'sourced' AS provenance FROM supplier")
def attributes(s: SparkSession, d: str) -> DataFrame:
    path, blank = scratch(s), F.lit(None).cast("string")
    df = v.table(s, d, "supplier").selectExpr("concat('id', s_suppkey) AS person_id", "concat(' ', s_name, ' ') AS name", "CASE s_suppkey % 3 WHEN 0 THEN 'RHB' WHEN 1 THEN 'LHB' END AS batting_hand", "'sourced' AS provenance")
    df = df.select(*[F.col(c) if c in df.columns else blank.alias(c) for c in ingest.ATTRIBUTES])
    ingest.save_attributes(df, path)
    return ingest.load_attributes(s, path).select("person_id", "name", "batting_hand", "provenance")


@query("S10_rates_round_trip", L(_COUNTS + _STATS + " SELECT cell, outcome, n, players, deliveries, round(prior, 9) AS prior, round(mean_runs, 6) AS mean_runs FROM st"))
def rates_round_trip(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s)
    ra.cell_stats(_counts(s, d)).write.parquet(path)
    return s.read.parquet(path).withColumn("prior", F.round("prior", 9)).withColumn("mean_runs", F.round("mean_runs", 6))


# -- text


@query("F1_F2_tokens", r"SELECT doc_id, concat(' ', trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z ]+', ' ', 'g'), ' +', ' ', 'g')), ' ') AS tokens, contains(concat(' ', trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z ]+', ' ', 'g'), ' +', ' ', 'g')), ' '), ' ther') AS has_ther FROM documents")
def tokens(s: SparkSession, d: str) -> DataFrame:
    t = tx.tokens(F.col("text"))
    return v.table(s, d, "documents").select("doc_id", t.alias("tokens"), tx.has(t, "ther").alias("has_ther"))


ARMS = ["Right-arm", "left arm", "", "RIGHT", "Leftarm", "right or left"]
HANDS = ["hand bat", "handed", "Unknown", "", "-hand, opener", "LEFT"]
STYLES = [
    "fast-medium", "swing", "offbreak", "leg spin", "slow orthodox", "chinaman", "Off-break", "Legbreak googly", "Orthodox", "Unorthodox spin", "wrist spin", "quick", "off cutter", "Slow", "bowler",
    "medium, off break", "Leg break, Off-break", "does not bowl", "no bowling: fast", "none", "", "occasional wicket keeper, medium", "seamer", "pace",
]
_TOKENS = "concat(' ', trim(regexp_replace(regexp_replace(lower(raw), '[^a-z ]+', ' ', 'g'), ' +', ' ', 'g')), ' ')"


def _phrases(*parts: list[str]) -> str:
    """SQL of ``doc_id`` and ``raw``: every combination of the parts comes up in the course of the table."""
    words, step = [], 1
    for p in parts:
        words.append(f"[{', '.join(map(_q, p))}][1 + (doc_id // {step} % {len(p)})::INT]")
        step *= len(p)
    return f"SELECT doc_id, trim(concat_ws(' ', {', '.join(words)})) AS raw FROM documents"


def _phrase(s: SparkSession, d: str, *parts: list[str]) -> DataFrame:
    words, step = [], 1
    for p in parts:
        words.append(F.element_at(F.array(*map(F.lit, p)), (F.floor(F.col("doc_id") / step) % len(p) + 1).cast("int")))
        step *= len(p)
    return v.table(s, d, "documents").select("doc_id", F.trim(F.concat_ws(" ", *words)).alias("raw"))


def _starts(*words: str) -> str:
    return "(" + " OR ".join(f"contains(t, ' {w}')" for w in words) + ")"


@query("F3_hands", f"SELECT doc_id, raw, CASE WHEN contains(t, ' left') = contains(t, ' right') THEN NULL WHEN contains(t, ' left') THEN 'LHB' ELSE 'RHB' END AS hand FROM (SELECT *, {_TOKENS} AS t FROM ({_phrases(ARMS, HANDS)}))")
def hands(s: SparkSession, d: str) -> DataFrame:
    return _phrase(s, d, ARMS, HANDS).select("doc_id", "raw", tx.hand(F.col("raw")).alias("hand"))


_FAMILIES = {"u": ("unorthodox", "chinaman", "wrist"), "g": ("leg break", "legbreak", "leg spin", "legspin", "googly"), "f": ("off break", "offbreak", "off spin", "offspin", "off cutter"), "o": ("orthodox",)}


@query("F4_bowling_classes", f"""WITH p AS (SELECT *, {_TOKENS} AS t FROM ({_phrases(ARMS, STYLES)})),
 w AS (SELECT *, contains(t, ' left') AND NOT contains(t, ' right') AS l, contains(t, ' right') AND NOT contains(t, ' left') AS r, {_starts("fast", "medium", "pace", "seam", "swing", "quick")} AS p, {", ".join(f"{_starts(*words)} AS {k}" for k, words in _FAMILIES.items())} FROM p)
 SELECT doc_id, raw, CASE WHEN {_starts("does not bowl", "doesnt bowl", "none", "non bowler", "no bowling")} OR u::INT + g::INT + f::INT + o::INT + p::INT <> 1 THEN NULL WHEN p THEN CASE WHEN l THEN 'LAP' WHEN r THEN 'RAP' END
  WHEN u THEN CASE WHEN r THEN 'LB' ELSE 'SLW' END WHEN g THEN CASE WHEN l THEN 'SLW' ELSE 'LB' END WHEN f THEN CASE WHEN l THEN 'SLA' ELSE 'OB' END ELSE CASE WHEN r THEN 'OB' ELSE 'SLA' END END AS bowl_class FROM w""")
def bowls(s: SparkSession, d: str) -> DataFrame:
    return _phrase(s, d, ARMS, STYLES).select("doc_id", "raw", tx.bowl_class(F.col("raw")).alias("bowl_class"))


@query("F5_F6_dates", "SELECT o_orderkey::BIGINT AS key, year(o_orderdate)::INT AS edition, strftime(o_orderdate, '%Y%m%d')::INT AS date_int FROM orders")
def dates(s: SparkSession, d: str) -> DataFrame:
    t = F.date_format("o_orderdate", "yyyy-MM-dd")
    return v.table(s, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("key"), tx.edition_year(t).alias("edition"), tx.date_int(t).alias("date_int"))


_LABELS = "CASE l_linenumber % 7 WHEN 0 THEN (l_orderkey % 200)::VARCHAR WHEN 1 THEN concat('a.', l_linenumber) WHEN 2 THEN concat(l_linenumber, '.x') ELSE concat(l_orderkey % 20, '.', l_linenumber) END"


@query("F8_ball_labels", f"SELECT label, CASE WHEN regexp_full_match(label, '[0-9]+[.][0-9]+') THEN split_part(label, '.', 1)::INT END AS over, CASE WHEN regexp_full_match(label, '[0-9]+[.][0-9]+') THEN split_part(label, '.', 2)::INT - 1 END AS ball, count(*) AS n FROM (SELECT {_LABELS} AS label FROM lineitem) GROUP BY ALL")
def labels(s: SparkSession, d: str) -> DataFrame:
    x = v.table(s, d, "lineitem").selectExpr("CASE l_linenumber % 7 WHEN 0 THEN cast(l_orderkey % 200 AS string) WHEN 1 THEN concat('a.', l_linenumber) WHEN 2 THEN concat(l_linenumber, '.x') ELSE concat(l_orderkey % 20, '.', l_linenumber) END AS label")
    o, b = tx.ball_label(F.col("label"))
    return x.groupBy("label").agg(F.count("*").alias("n")).select("label", o.alias("over"), b.alias("ball"), "n")


@query("F7_F18_json_fields", "SELECT event_id, (props ->> '$.k')::INT AS k, coalesce(props ->> '$.stage', '') AS stage FROM events")
def json_fields(s: SparkSession, d: str) -> DataFrame:
    return v.table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), tx.stage(F.get_json_object("props", "$.stage")).alias("stage"))


@query("F9_F10_short_names", "SELECT n_name AS name, CASE n_name WHEN 'CHINA' THEN 'CHN' ELSE upper(array_to_string(list_transform(list_filter(regexp_split_to_array(n_name, ' +'), lambda w: w <> ''), lambda w: substr(w, 1, 1)), '')) END AS short, CASE WHEN contains(trim(n_name), ' ') THEN upper(concat(regexp_extract(split_part(n_name, ' ', 1), '([A-Za-z])', 1), regexp_extract(list_last(string_split(n_name, ' ')), '([A-Za-z])', 1))) ELSE upper(substr(n_name, 1, 2)) END AS monogram FROM nation")
def short_names(s: SparkSession, d: str) -> DataFrame:
    n = F.col("n_name")
    return v.table(s, d, "nation").select(n.alias("name"), tx.short_team(n, {"CHINA": "CHN"}).alias("short"), tx.monogram(n).alias("monogram"))


@query("F11_one_decimal", "SELECT p_partkey::BIGINT AS key, printf('%.1f', floor(p_retailprice * 10 + 0.5) / 10) AS shown FROM part")
def one_decimal(s: SparkSession, d: str) -> DataFrame:
    return v.table(s, d, "part").select(F.col("p_partkey").cast("bigint").alias("key"), tx.one_decimal(F.col("p_retailprice")).alias("shown"))


# what is not of ASCII shows as an escape of its byte, and so does a backslash
@query("F12_clean_player", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(unhex(substr(hex(encode(regexp_replace(text, '^[\s\x85\xA0]+|[\s\x85\xA0]+$', '', 'g'))), 1, 48))::VARCHAR, '\\x[0-9A-F]{2}', '', 'g'), '[^A-Za-z0-9_\- ]', '', 'g'), ' ') AS player FROM documents""")
def clean_player(s: SparkSession, d: str) -> DataFrame:
    return v.table(s, d, "documents").select("doc_id", tx.clean_player(F.col("text")).alias("player"))


_INTENTS = ["b", " ATTACK ", "", "r", "sweep", "a", "Block", "rotate", "attacking", "R "]


@query("F13_intents", f"SELECT doc_id, raw, CASE WHEN lower(trim(raw)) IN ('b', 'block') THEN 'block' WHEN lower(trim(raw)) IN ('', 'r', 'rotate') THEN 'rotate' WHEN lower(trim(raw)) IN ('a', 'attack') THEN 'attack' END AS intent FROM ({_phrases(_INTENTS)})")
def intents(s: SparkSession, d: str) -> DataFrame:
    return _phrase(s, d, _INTENTS).select("doc_id", "raw", tx.intent(F.col("raw")).alias("intent"))


_SITUATION = "concat('free:', 165 + doc_id % 60, ':', CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE ((doc_id * 37) % 300)::VARCHAR END)"


@query("F14_situations", f"SELECT doc_id, id, CASE WHEN ok THEN t END AS target, CASE WHEN ok THEN w END AS venue FROM (SELECT *, t BETWEEN 172 AND 214 AND w BETWEEN 0 AND 254 AS ok FROM (SELECT doc_id, {_SITUATION} AS id, (165 + doc_id % 60)::INT AS t, CASE WHEN doc_id % 11 <> 0 THEN ((doc_id * 37) % 300)::INT END AS w FROM documents))")
def situations(s: SparkSession, d: str) -> DataFrame:
    df = v.table(s, d, "documents").selectExpr("doc_id", _SITUATION.replace("((doc_id * 37) % 300)::VARCHAR", "cast((doc_id * 37) % 300 as string)") + " AS id")
    t, w = tx.parse_situation(F.col("id"))
    return df.select("doc_id", "id", t.alias("target"), w.alias("venue"))


def _wiki_sql(x: str) -> str:
    for pattern, to in ((r"(?s)<!--.*?-->", ""), (r"(?s)<ref[^>]*/>", ""), (r"(?s)<ref[^>]*>.*?</ref>", ""), (r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", r"\1"), (r"\{\{[^{}]*\}\}", ""), (r"<[^>]*>", ""), (r"'{2,}", ""), (r"\s+", " ")):
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return f"trim({x}, ' ')"


@query("S13_S14_load_report", E("""
, q AS (SELECT unnest([{'key': 'deliveries', 'kind': 'count', 'value': (SELECT count(*) FROM d)::DOUBLE}, {'key': 'legal', 'kind': 'count', 'value': (SELECT count(*) FROM d WHERE wides = 0 AND noballs = 0)::DOUBLE}, {'key': 'wickets', 'kind': 'count', 'value': (SELECT count(wicket) FROM d)::DOUBLE},
   {'key': 'matches', 'kind': 'count', 'value': (SELECT count(DISTINCT match_id) FROM d)::DOUBLE}, {'key': 'unresolved', 'kind': 'fault', 'value': 0.0::DOUBLE}, {'key': 'city', 'kind': 'coverage', 'value': 0.0::DOUBLE}, {'key': 'venue', 'kind': 'coverage', 'value': 1.0::DOUBLE}, {'key': 'toss', 'kind': 'coverage', 'value': 0.0::DOUBLE}, {'key': 'winner', 'kind': 'coverage', 'value': 0.0::DOUBLE}]) AS x)
 SELECT x.key AS key, x.kind AS kind, x.value AS value, concat('| ', x.key, ' | ', x.kind, ' | ', x.value, ' |') AS line FROM q"""))
def load_report(s: SparkSession, d: str) -> DataFrame:
    """A whole load through its gate, then both of its reports read back."""
    root = scratch(s)
    x = v.ordered(s, d)
    _documents(x).write.partitionBy("day").text(f"{root}/matches.json")
    everyone = x.select(F.explode(F.array("batter", "bowler", "non_striker")).alias("p")).distinct()
    everyone.select(F.concat(F.lit("id"), F.col("p").cast("string")).alias("identifier"), F.concat(F.lit("N"), F.col("p").cast("string")).alias("unique_name")).write.option("header", True).csv(f"{root}/register")
    loader.load(s, root, f"{root}/register", f"{root}/out")
    lines = s.read.text(f"{root}/out/quality.md").select(F.col("value").alias("line"), F.get(F.split("value", r"\|"), F.lit(1)).alias("cell"))
    return loader.read_report(s, f"{root}/out/quality.json").join(lines, F.col("key") == F.trim("cell")).select("key", "kind", "value", "line")


@query("P11_ranges", r"WITH t AS (SELECT l_orderkey::BIGINT AS k, l_linenumber::INT AS n, concat(CASE l_linenumber WHEN 7 THEN ' ' ELSE '' END, l_linenumber * 3 - 2, CASE l_suppkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN '--' ELSE '-' END, l_quantity::INT) AS spec, l_linenumber * 3 - 2 AS lo, l_quantity::INT AS hi, l_suppkey % 5 > 1 AS dash FROM lineitem) SELECT k, n, spec, CASE WHEN dash AND lo >= 1 AND lo <= hi AND hi <= 20 THEN (lo - 1)::INT END AS first, CASE WHEN dash AND lo >= 1 AND lo <= hi AND hi <= 20 THEN hi - 1 END AS last FROM t")
def ranges(s: SparkSession, d: str) -> DataFrame:
    t = v.table(s, d, "lineitem").selectExpr("cast(l_orderkey as bigint) AS k", "cast(l_linenumber as int) AS n", "concat(CASE l_linenumber WHEN 7 THEN ' ' ELSE '' END, cast(l_linenumber * 3 - 2 as string), CASE l_suppkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN '--' ELSE '-' END, cast(cast(l_quantity as int) as string)) AS spec")
    first, last = ag.range_of(F.col("spec"))
    return t.select("k", "n", "spec", first.alias("first"), last.alias("last"))


_WIKI_HEAD = "[[Right-arm fast|fast bowler]] <ref>x</ref> QQQbQQQ <!-- c\n--> {{flag|X}} [[Y]]<br/>z <ref name=a/> ".replace("Q", "'")
_WIKI = "concat('" + _WIKI_HEAD.replace("'", "''") + "', html)"


@query("F15_wikitext", f"SELECT page_id, {_wiki_sql(_WIKI)} AS clean FROM pages")
def wikitext(s: SparkSession, d: str) -> DataFrame:
    return v.table(s, d, "pages").select("page_id", tx.clean_wikitext(F.concat(F.lit(_WIKI_HEAD), F.col("html"))).alias("clean"))


@query("F16_templates", r"""WITH p AS (SELECT page_id, regexp_replace(html, '[{}]', '', 'g') AS html, regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^A-Za-z0-9 ]', '', 'g') AS t FROM pages)
 SELECT page_id, concat(html, ' ', concat_ws(', ', nullif(trim(t), ''), concat(page_id, ', ', page_id % 7)), ' / ', page_id, '{{', html) AS expanded FROM p""")
def templates(s: SparkSession, d: str) -> DataFrame:
    t = F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "[^A-Za-z0-9 ]", "")
    html = F.regexp_replace("html", "[{}]", "")
    raw = F.concat(html, F.lit(" {{Plainlist|class=x|"), t, F.lit("|{{ubl| "), F.col("page_id").cast("string"), F.lit(" ||{{gone|{{flag|a}}|b}}{{hlist|"), (F.col("page_id") % 7).cast("string"), F.lit("}}}}}}{{note\n|x}} / {{ flatlist |"), F.col("page_id").cast("string"), F.lit("|k=v}}{{"), html)
    return v.table(s, d, "pages").select("page_id", tx.expand_templates(raw).alias("expanded"))


@query("F17_S15_infobox", r"SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ') AS bowling, '' AS batting, '' AS absent FROM pages")
def infobox(s: SparkSession, d: str) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    raw = F.concat(html, F.lit("\n{{Infobox\n |BOWLING =  "), F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("  \n| bowling = second\n| batting =\n| x = 1\n}}\n"), html)
    return v.table(s, d, "pages").select("page_id", *[tx.infobox_field(raw, n).alias(n) for n in ("bowling", "batting", "absent")])


@query("F15_F17_pages", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, trim(regexp_replace(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g'), ' ') AS heading FROM pages")
def page_fields(s: SparkSession, d: str) -> DataFrame:
    return v.table(s, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), "<[^>]*>", ""), r"\s+", " ")).alias("heading"))


_VENUES = "SELECT concat(n_name, CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat(', ', n_name) ELSE ', the, far' END) AS venue FROM nation"


@query("F23_stable_attributes", f"""WITH v AS ({_VENUES}), h AS (SELECT venue, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(venue, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: (xor(a, b) * 16777619) % 4294967296) AS h FROM v)
 SELECT venue, CASE WHEN contains(venue, ', ') THEN regexp_extract(venue, '^(.+), (.*)$', 1) ELSE venue END AS name, regexp_extract(venue, '^(.+), (.*)$', 2) AS city, (66 + h % 11)::INT AS straight, (60 + (h >> 8) % 9)::INT AS square, (15000 + (h >> 16) % 30000)::INT AS capacity, (1 + (h >> 4) % 3)::INT AS tiers, CASE (h >> 12) % 3 WHEN 1 THEN 'partial' ELSE 'none' END AS roof, CASE (h >> 20) % 2 WHEN 0 THEN 'pylons' ELSE 'roof' END AS lights FROM h""")
def stable(s: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey") % 3
    venue = F.concat("n_name", F.when(n == 0, "").when(n == 1, F.concat(F.lit(", "), "n_name")).otherwise(", the, far"))
    df = v.table(s, d, "nation").select(venue.alias("venue"))
    return df.select("venue", *[c.alias(k) for k, c in tx.stable_attributes(F.col("venue")).items()])


_SECRET = b"master"


def _mac_sql(key: bytes | str, message: str) -> str:
    """HMAC-SHA256 in SQL, as a blob; the key is fixed or an expression of 32 bytes."""
    if isinstance(key, bytes):
        pad = lambda p: "unhex('" + bytes(x ^ p for x in key.ljust(64, bytes(1))).hex() + "')"
    else:
        pad = lambda p: f"xor(({key} || unhex('{'00' * 32}'))::BIT, unhex('{f'{p:02x}' * 64}')::BIT)::BLOB"
    return f"unhex(sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || {message}))))"


_PRK = hmac.digest(bytes(32), _SECRET, "sha256")


@query("F20_F21_keys", f"""WITH e AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day FROM events), k AS (SELECT *, {_mac_sql(_PRK, "encode('seamline/' || day) || unhex('01')")} AS key FROM e)
 SELECT event_id, lower(hex(key)) AS key, translate(rtrim(to_base64({_mac_sql(_SECRET, "encode('run-' || event_id || '|' || day)")}), '='), '+/', '-_') AS token, lower(hex({_mac_sql("key", "encode(event_id::VARCHAR)")})) AS mac, user_id % 3 > 0 AS valid FROM k""")
def keys(s: SparkSession, d: str) -> DataFrame:
    """A day's key, a run's token, a code by the day's key, and whether a token, every third one another run's, holds: for every event."""
    e = v.table(s, d, "events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).withColumn("key", tx.derive_key(_SECRET, F.col("day")))
    run = F.concat(F.lit("run-"), F.col("event_id").cast("string"))
    claimed = F.when(F.col("user_id") % 3 > 0, run).otherwise(F.concat(run, F.lit("x")))
    mac = tx.hmac_sha256(F.col("key"), F.encode(F.col("event_id").cast("string"), "UTF-8"))
    return e.select("event_id", F.lower(F.hex("key")).alias("key"), tx.run_token(_SECRET, run, F.col("day")).alias("token"), F.lower(F.hex(mac)).alias("mac"), tx.check_token(_SECRET, claimed, F.col("day"), tx.run_token(_SECRET, run, F.col("day"))).alias("valid"))


@query("F24_local_dates", "SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day FROM events")
def local_dates(s: SparkSession, d: str) -> DataFrame:
    return v.table(s, d, "events").select("event_id", tx.local_date(F.col("ts")).alias("day"))


@query("F25_share_text", E(" SELECT id, concat(date, chr(10), CASE defended WHEN 1 THEN '++=' ELSE '-=-' END, chr(10), CASE chased WHEN 1 THEN '+' ELSE '-' END, CASE WHEN total_score > 100 THEN concat(chr(10), '50% did both') ELSE '' END, CASE WHEN finished_at % 4 > 1 THEN concat(chr(10), 'streak ', finished_at % 4) ELSE '' END) AS share FROM runs"))
def share(s: SparkSession, d: str) -> DataFrame:
    r = v.results(s, d)
    g = F.when(F.col("defended") == 1, "ggl").otherwise("blb"), F.when(F.col("chased") == 1, "g").otherwise("b")
    return r.select("id", tx.share_text(F.col("date"), *g, F.when(F.col("total_score") > 100, 2).otherwise(1), F.lit(50), F.pmod("finished_at", F.lit(4))).alias("share"))


# -- evaluation

_SCORED = "SELECT doc_id, toxic, ((doc_id * 37 + toxic * 29) % 101) / 101.0::DOUBLE AS p FROM labels"


def _scored(s: SparkSession, d: str) -> DataFrame:
    return v.table(s, d, "labels").selectExpr("doc_id", "toxic", "cast((doc_id * 37 + toxic * 29) % 101 as double) / 101.0D AS p")


@query("B12_log_loss", f"SELECT count(*) AS n, round(avg(-ln(greatest(CASE WHEN toxic = 1 THEN p ELSE 1 - p END, 1e-15))), 6) AS log_loss FROM ({_SCORED}) t")
def log_loss(s: SparkSession, d: str) -> DataFrame:
    return mo.log_loss(_scored(s, d).withColumn("p_true", F.when(F.col("toxic") == 1, F.col("p")).otherwise(1 - F.col("p"))))


_BINS = f"SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS f, avg(toxic::DOUBLE) AS r FROM ({_SCORED}) t GROUP BY 1 HAVING count(*) >= 20"


@query("B13_reliability", f"SELECT bin, n, round(f, 6) AS forecast, round(r, 6) AS rate FROM ({_BINS}) b")
def reliability(s: SparkSession, d: str) -> DataFrame:
    return mo.reliability(_scored(s, d), "p", "toxic")


@query("B13_calibration_error", f"SELECT round(coalesce(sum(n * abs(f - r)) / sum(n), 0), 6) AS ece FROM ({_BINS}) b")
def ece(s: SparkSession, d: str) -> DataFrame:
    return mo.calibration_error(_scored(s, d), "p", "toxic")


@query("B14_binary_scores", f"""
WITH t AS ({_SCORED}), r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM t), a AS (SELECT count(*) AS n, sum(toxic)::DOUBLE AS pos FROM t)
SELECT a.n, round(avg((p - toxic) * (p - toxic)), 6) AS brier, round(avg(-(toxic * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - toxic) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))), 6) AS log_loss,
 round(-(pos / a.n * ln(pos / a.n) + (1 - pos / a.n) * ln(1 - pos / a.n)), 6) AS base_log_loss, round(((sum(rk) FILTER (toxic = 1))::DOUBLE - pos * (pos + 1) / 2) / (pos * (a.n - pos)), 6) AS auc FROM r, a GROUP BY a.n, pos""")
def binary(s: SparkSession, d: str) -> DataFrame:
    return mo.binary_scores(_scored(s, d), "p", "toxic")


@query("B15_recency_weights", L(" SELECT season, round(pow(0.95, greatest(0, 1999 - season)), 9) AS weight, count(*) AS n FROM x GROUP BY ALL"))
def recency(s: SparkSession, d: str) -> DataFrame:
    return lx(s, d).groupBy("season", F.round(mo.recency_weight(F.col("season"), 1999), 9).alias("weight")).agg(F.count("*").alias("n"))


@query("B18_chase_rules", L(" SELECT innings_id, over, CASE WHEN q <= 0 THEN 1.0::DOUBLE WHEN b <= 0 OR w <= 0 THEN 0.0::DOUBLE WHEN q > 6 * b THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS p, count(*) AS n FROM (SELECT innings_id, over, runs_bat * 10 - 10 AS q, over - 1 AS b, runs_bat AS w FROM x) t GROUP BY ALL"))
def chase(s: SparkSession, d: str) -> DataFrame:
    p = mo.chase_rules(F.lit(0.5), F.col("runs_bat") * 10 - 10, F.col("over") - 1, F.col("runs_bat"))
    return lx(s, d).groupBy("innings_id", "over", p.alias("p")).agg(F.count("*").alias("n"))


_BUMPY = "1 / (1 + exp(need * 6.0 / balls - 6.5 - 0.3 * wickets)) + CASE WHEN need % 10 = 7 OR balls % 30 = 29 OR wickets = 4 THEN 0.05 ELSE 0.0 END"


@query("B16_monotone_grid", f"""WITH g AS (SELECT 'need' AS feature, v AS value, false AS rising, v AS need, 60 AS balls, 6 AS wickets FROM range(1, 160, 2) t(v) UNION ALL SELECT 'balls', v, true, 60, v, 6 FROM range(1, 120, 2) t(v) UNION ALL SELECT 'wickets', v, true, 60, 60, v FROM range(1, 11) t(v)),
 s AS (SELECT *, p - lag(p) OVER (PARTITION BY feature ORDER BY value) AS step FROM (SELECT *, CASE WHEN need > 6 * balls THEN 0.0 ELSE {_BUMPY} END AS p FROM g))
 SELECT feature, rising, count(*) FILTER (CASE WHEN rising THEN step < -1e-12 ELSE step > 1e-12 END) AS violations FROM s GROUP BY ALL""")
def monotone(s: SparkSession, d: str) -> DataFrame:
    p = mo.chase_rules(F.expr(_BUMPY), F.col("need"), F.col("balls"), F.col("wickets"))  # with bumps, which must be found
    return mo.sweep_violations(mo.monotone_sweeps(s).withColumn("p", p), "p")


@query("B10_affordable", "SELECT * FROM (VALUES (0, 6), (1, 6), (2, 5), (3, 3), (4, 3), (5, 12)) t(i, cost)")
def affordable(s: SparkSession, d: str) -> DataFrame:
    return _rows(s, list(enumerate(ra.affordable([9, 9, 8, 6, 5, 15], 4, 17))), "i int, cost int")


_MARGINS = ("0.0", "(balls_left - need) / 10.0", "wickets_left / 4.0 - 2")


def _temperature_sql() -> str:
    """The slope at the same bounds, on ever finer grids of the inverse temperature's log."""
    sql = f"WITH m AS MATERIALIZED (SELECT {', '.join(f'({x})::DOUBLE AS m{i}' for i, x in enumerate(_MARGINS))}, label FROM ({QUERIES['E3_S12_win_matrix'][1]}) w), b0 AS (SELECT -2.0::DOUBLE AS lo, 2.0::DOUBLE AS hi)"
    for k in range(5):
        sql += f""", g{k} AS (SELECT i, lo + (hi - lo) * i / 32 AS t, exp(lo + (hi - lo) * i / 32) AS b FROM b{k}, range(33) r(i)),
 s{k} AS (SELECT i, sum((e0 * m0 + e1 * m1 + e2 * m2) / (e0 + e1 + e2) - CASE label WHEN 1 THEN m1 ELSE m0 END) AS slope FROM (SELECT *, exp(b * (m0 - z)) AS e0, exp(b * (m1 - z)) AS e1, exp(b * (m2 - z)) AS e2 FROM (SELECT *, greatest(m0, m1, m2) AS z FROM m, g{k}) q) q GROUP BY i),
 b{k + 1} AS MATERIALIZED (SELECT (SELECT t FROM g{k} WHERE i = greatest(0, f - 1)) AS lo, (SELECT t FROM g{k} WHERE i = least(32, f)) AS hi FROM (SELECT coalesce(min(i) FILTER (slope >= 0), 33) AS f FROM s{k}) q)"""
    return sql + " SELECT (SELECT count(*) FROM m) AS n, round(exp(-(lo + hi) / 2), 3) AS temperature FROM b5"


@query("B11_temperature", _temperature_sql())
def temperature(s: SparkSession, d: str) -> DataFrame:
    from seamline.plans.registry import win_matrix

    m = written(win_matrix(s, d).selectExpr(f"array({', '.join(f'cast({x} as double)' for x in _MARGINS)}) AS m", "label"), "margins")
    return m.agg(F.count("*").alias("n")).withColumn("temperature", F.lit(round(mo.fit_temperature(m, "m", "label"), 3)))


# -- arrays and draws

_P9 = [0.35, 0.3, 0.06, 0.01, 0.11, 0.06, 0.05, 0.04, 0.02]
_ARR = "[" + ", ".join(f"{p}::DOUBLE" for p in _P9) + "]"
_RUNS = "[0, 1, 2, 3, 4, 6, 0, 1, 1]"


def _array(values: list[float]):
    return F.array(*[F.lit(float(x)) for x in values])


@query("M5_tilt", f"WITH l AS (SELECT i, i / 10.0::DOUBLE AS s FROM range(-5, 6) t(i)), k AS (SELECT i, unnest(range(9)) AS k, s FROM l), w AS (SELECT i, k, ({_ARR})[k + 1] * exp(s * ({_RUNS})[k + 1]) AS w FROM k) SELECT i::BIGINT AS i, k::INT AS outcome, round(w / sum(w) OVER (PARTITION BY i), 9) AS p FROM w")
def tilt(s: SparkSession, d: str) -> DataFrame:
    df = s.range(-5, 6).withColumnRenamed("id", "i").withColumn("p", mo.tilt(_array(_P9), _array(ball.NOMINAL_RUNS), F.col("i") / 10.0))
    return df.select("i", F.posexplode("p").alias("outcome", "p")).withColumn("p", F.round("p", 9))


@query("M6_apply_intent", f"""
WITH l AS (SELECT t.v AS intent, r.v AS required FROM (VALUES ('block'), ('rotate'), ('attack')) t(v), range(2, 13) r(v)), k AS (SELECT *, unnest(range(9)) AS k FROM l),
 w AS (SELECT *, ({_ARR})[k + 1] * exp(CASE intent WHEN 'block' THEN -0.30::DOUBLE WHEN 'attack' THEN 0.34::DOUBLE ELSE 0 END * ({_RUNS})[k + 1]) AS w FROM k), p AS (SELECT intent, required, k, w / sum(w) OVER (PARTITION BY intent, required) AS p FROM w),
 q AS (SELECT *, max(CASE WHEN k = 6 THEN p END) OVER (PARTITION BY intent, required) AS pw FROM p), u AS (SELECT *, least(pw * (1 + 1.8::DOUBLE * (7 - required) / 7), 1.0) AS nw FROM q)
SELECT intent, required::BIGINT AS required, k::INT AS outcome, round(CASE WHEN intent = 'attack' AND required < 7 THEN CASE WHEN k = 6 THEN nw ELSE p * (1 - nw) / (1 - pw) END ELSE p END, 9) AS p FROM u""")
def apply_intent(s: SparkSession, d: str) -> DataFrame:
    grid = _rows(s, [("block",), ("rotate",), ("attack",)], "intent string").crossJoin(s.range(2, 13).withColumnRenamed("id", "required"))
    p = mo.apply_intent(_array(_P9), F.col("intent"), F.col("required").cast("double"), _array(ball.NOMINAL_RUNS))
    return grid.select("intent", "required", F.posexplode(p).alias("outcome", "p")).withColumn("p", F.round("p", 9))


_U = "('0x' || substr(sha256(concat_ws('|', 'key', innings_id % 2, over, legal_ball, bowler % 5 + 16)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query("M7_M8_draw_and_sample", E(", w AS (SELECT delivery_id, innings_id, over, bowler, coalesce(sum(legal::INT) OVER (PARTITION BY innings_id, over ORDER BY delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS legal_ball FROM x)" + f", u AS (SELECT delivery_id, {_U} AS u FROM w) SELECT delivery_id, u, coalesce((SELECT min(k) FROM range(9) t(k) WHERE u < list_sum(list_slice({_ARR}, 1, k::INT + 1))), 8)::INT AS outcome FROM u"))
def draw_sample(s: SparkSession, d: str) -> DataFrame:
    x = wi.running_state(ex(s, d))
    u = mo.draw(F.lit("key"), F.pmod("innings_id", F.lit(2)), F.col("over"), F.col("legal_ball"), mo.encode_choice(F.pmod("bowler", F.lit(5)), F.lit(1)))
    return x.select("delivery_id", u.alias("u")).withColumn("outcome", mo.sample(_array(_P9), F.col("u")))


@query("M10_completable", """
WITH g AS (SELECT a.v AS a, b.v AS b, c.v AS c, d.v AS d, e.v AS e, l.v AS last FROM range(5) a(v), range(5) b(v), range(5) c(v), range(5) d(v), range(5) e(v), range(-1, 5) l(v)), h AS (SELECT *, a + b + c + d + e AS n, greatest(a, b, c, d, e) AS top, CASE last WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN c WHEN 3 THEN d WHEN 4 THEN e ELSE -1 END AS mine FROM g)
SELECT a, b, c, d, e, last, n = 0 OR (top <= (n + 1) // 2 AND NOT (n % 2 = 1 AND mine = (n + 1) // 2)) AS ok FROM h""")
def completable(s: SparkSession, d: str) -> DataFrame:
    g = s.range(18750).selectExpr("id % 5 AS a", "id div 5 % 5 AS b", "id div 25 % 5 AS c", "id div 125 % 5 AS d", "id div 625 % 5 AS e", "id div 3125 - 1 AS last")
    ok = si.completable_column(F.array(*[F.col(c).cast("int") for c in "abcde"]), F.col("last").cast("int"))
    return g.withColumn("ok", ok)


@query("M12_innings_results", E(", t AS (SELECT match_id, innings_id, sum(total)::BIGINT AS runs, count(*) FILTER (costs) AS wickets FROM x WHERE NOT super_over GROUP BY ALL), g AS (SELECT *, lag(runs) OVER (PARTITION BY match_id ORDER BY innings_id) + 1 AS target FROM t) SELECT innings_id, runs, wickets, target, runs < target AS defended, CASE WHEN runs < target THEN target - 1 - runs END AS run_margin, CASE WHEN runs >= target THEN greatest(0, 10 - wickets) END AS wicket_margin, wickets >= 10 AS all_out FROM g WHERE target IS NOT NULL"))
def innings_results(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    t = ex(s, d).where("NOT super_over").groupBy("match_id", "innings_id").agg(F.sum("total").alias("runs"), F.count_if("costs").alias("wickets"))
    g = t.withColumn("target", F.lag("runs").over(W.partitionBy("match_id").orderBy("innings_id")) + 1).where("target IS NOT NULL")
    return g.selectExpr("innings_id", "runs", "wickets", "target", "runs < target AS defended", "CASE WHEN runs < target THEN target - 1 - runs END AS run_margin", "CASE WHEN runs >= target THEN greatest(0, 10 - wickets) END AS wicket_margin", "wickets >= 10 AS all_out")


@query("M16_decision_values", E(" , o AS (SELECT innings_id // 2 * 100 + over AS decision, CASE WHEN over % 2 = 0 THEN 'bowling' ELSE 'batting' END AS side, avg(k) AS wp, bowler, bowler % 7 = 0 AS chosen FROM (SELECT *, runs_bat / 6.0::DOUBLE AS k FROM x) t GROUP BY ALL), g AS (SELECT decision, side, count(*) AS options, avg(wp) AS mean, max(CASE WHEN chosen THEN wp END) AS wp FROM o GROUP BY ALL) SELECT decision, side, options, round(CASE WHEN options < 2 THEN 0.0 ELSE CASE side WHEN 'bowling' THEN -1 ELSE 1 END * (wp - mean) END, 6) AS value FROM g"))
def decisions(s: SparkSession, d: str) -> DataFrame:
    o = ex(s, d).selectExpr("innings_id div 2 * 100 + over AS decision", "CASE WHEN over % 2 = 0 THEN 'bowling' ELSE 'batting' END AS side", "bowler", "runs_bat / 6.0D AS k", "bowler % 7 = 0 AS chosen").groupBy("decision", "side", "bowler", "chosen").agg(F.avg("k").alias("wp"))
    return si.decision_values(o)


@query("M15_reference_intents", "SELECT w::BIGINT AS wickets, r::BIGINT AS rate, o::BIGINT AS over, a::BIGINT AS attacks_left, CASE WHEN w >= 8 AND r < 12 THEN 'block' WHEN a > 0 AND (a >= 20 - o OR r > 9 OR o >= 15) THEN 'attack' ELSE 'rotate' END AS intent FROM range(10) t1(w), range(2, 15) t2(r), range(20) t3(o), range(7) t4(a)")
def reference_intents(s: SparkSession, d: str) -> DataFrame:
    g = s.range(10).withColumnRenamed("id", "wickets")
    for name, grid in (("rate", s.range(2, 15)), ("over", s.range(20)), ("attacks_left", s.range(7))):
        g = g.crossJoin(grid.withColumnRenamed("id", name))  # a fixed grid
    return g.withColumn("intent", si.intent_rules(F.col("wickets"), F.col("rate"), F.lit(20) - F.col("over"), F.col("attacks_left"), F.col("over")))


JUDGED = [(1, 0.50, 0.48, 0.022), (2, 0.35, 0.65, 0.018), (3, 0.80, 0.50, 0.022), (4, 0.50, 0.85, 0.022), (5, 0.50, 0.50, 0.004), (6, 0.9, 0.1, 0.0)]


@query("M19_K7_judge", _values(JUDGED, "attempt, defend_rate, chase_rate, spread").replace("SELECT *", "SELECT attempt, concat_ws('; ', CASE WHEN defend_rate NOT BETWEEN 0.35 AND 0.65 THEN 'defence out of band' END, CASE WHEN chase_rate NOT BETWEEN 0.35 AND 0.65 THEN 'chase out of band' END, CASE WHEN spread < 0.018 THEN 'decisions matter too little' END) AS rejections, round((10 * spread + 1 - (abs(defend_rate - 0.5) + abs(chase_rate - 0.5)) / 2)::DOUBLE, 6) AS rank_score"))
def judge(s: SparkSession, d: str) -> DataFrame:
    return si.judged(_rows(s, JUDGED, "attempt int, defend_rate double, chase_rate double, spread double")).select("attempt", "rejections", "rank_score")


@query("K7_best_accepted", "SELECT '2024-01-01' AS date, 3 AS attempt, 1.2::DOUBLE AS rank_score")
def best(s: SparkSession, d: str) -> DataFrame:
    rows = [("2024-01-01", 1, 0.4, 0.5, 0.02), ("2024-01-01", 2, 0.5, 0.5, 0.018), ("2024-01-01", 3, 0.4, 0.4, 0.03), ("2024-01-01", 4, 0.5, 0.5, 0.5), ("2024-01-01", 5, 0.9, 0.5, 0.5)]
    return si.best_accepted(si.judged(_rows(s, rows, "date string, attempt int, defend_rate double, chase_rate double, spread double"))).withColumn("rank_score", F.round("rank_score", 6))


@query("M21_deal_attack")
def deal(s: SparkSession, d: str) -> DataFrame:
    return si.deal_attack(_pool(s, d), "day-1")


@query("M22_batting_card", E(", a AS (SELECT innings_id, batter AS player, min(delivery_id) AS seen, max(CASE WHEN costs AND player_out = batter THEN 1 ELSE 0 END) AS o FROM x GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY innings_id ORDER BY seen) AS place FROM a) SELECT innings_id, player, CASE WHEN o = 1 THEN 'out' WHEN place < 8 THEN 'in' ELSE 'yet' END AS status FROM p"))
def card(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    a = ex(s, d).groupBy("innings_id", F.col("batter").alias("player")).agg(F.min("delivery_id").alias("seen"), F.max(F.expr("costs AND player_out = batter")).alias("out"))
    p = a.withColumn("place", F.row_number().over(W.partitionBy("innings_id").orderBy("seen")))
    return p.select("innings_id", "player", re_.card_status(F.col("place"), F.coalesce("out", F.lit(False)), F.lit(8)).alias("status"))


# -- simulation and models

_CANDIDATE = si.Candidate(tuple(tuple(x / sum(p) for x in p) for p in ([w - 0.02 * i if k == 4 else w + 0.02 * i if k == 0 else w for k, w in enumerate(_P9)] for i in range(5))))


@query("A20_M11_M14_M17_monte_carlo")
def monte_carlo(s: SparkSession, d: str) -> DataFrame:
    ship(s)
    return si.reduce_games(si.monte_carlo(s, _CANDIDATE, [150, 165], 128, "day-1"))


@query("M20_M23_sweep")
def sweep(s: SparkSession, d: str) -> DataFrame:
    ship(s)
    return si.reduce_games(si.monte_carlo(s, _CANDIDATE, [140, 170], 48, "day-1", ["best", "worst", "first", "save_best"], ["never", "early", "late", "needed"]))


@query("M18_solve_target")
def solve(s: SparkSession, d: str) -> DataFrame:
    ship(s)
    return _rows(s, [(si.solve_target(s, _CANDIDATE, "day-1", 64),)], "target int")


_SIX = ["need", "balls_left", "wickets_left", "required_rate", "current_rate", "venue_rate"]
_TREES, _CLASSES = 585, 9


def synthetic_model(trees: int = _TREES, classes: int = _CLASSES) -> str:
    """A model of full trees with eight leaves in the text format, its numbers by rule."""
    out = [f"tree\nversion=v3\nnum_class={classes}\nfeature_names={' '.join(_SIX)}\n"]
    for t in range(trees):
        line = lambda name, values: f"{name}={' '.join(map(str, values))}\n"
        out.append(f"\nTree={t}\nnum_leaves=8\nnum_cat=0\n" + line("split_feature", [(t + j) % 6 for j in range(7)]) + line("threshold", [(t * 7 + j * 13) % 97 / 4 for j in range(7)]) + line("decision_type", [2] * 7)
                   + line("left_child", [1, 3, 5, -1, -3, -5, -7]) + line("right_child", [2, 4, 6, -2, -4, -6, -8]) + line("leaf_value", [((t * 31 + i * 17) % 101 - 50) / 1000 for i in range(8)]) + "is_linear=0\n")
    return "".join(out)


def _ensemble_sql() -> str:
    """Every row goes down every tree: a node's children are 2 j + 1 and 2 j + 2, leaves follow the seven inner nodes."""
    goes = lambda j: f"2 * ({j}) + CASE WHEN v[((t + ({j})) % 6 + 1)::INT] <= ((t * 7 + ({j}) * 13) % 97) / 4.0::DOUBLE THEN 1 ELSE 2 END"
    return f"""WITH m AS (SELECT delivery_id, [{', '.join(f'{c}::DOUBLE' for c in _SIX)}] AS v FROM ({QUERIES["E3_S12_win_matrix"][1]}) w), r AS (SELECT delivery_id, v, t FROM m, range({_TREES}) r(t)),
 a AS (SELECT *, {goes("0")} AS j FROM r), b AS (SELECT delivery_id, v, t, {goes("j")} AS j FROM a), c AS (SELECT delivery_id, t, {goes("j")} - 7 AS leaf FROM b),
 s AS (SELECT delivery_id, (t % {_CLASSES})::INT AS k, sum(((t * 31 + leaf * 17) % 101 - 50) / 1000.0::DOUBLE) / 1.1::DOUBLE AS z FROM c GROUP BY ALL)
 SELECT delivery_id, k AS outcome, round(exp(z) / sum(exp(z)) OVER (PARTITION BY delivery_id), 9) AS p FROM s"""


@query("M1_M2_M3_S18_ensemble", _ensemble_sql())
def ensemble(s: SparkSession, d: str) -> DataFrame:
    from seamline.plans.registry import win_matrix

    ship(s)
    df = mo.score(win_matrix(s, d), mo.parse_ensemble(synthetic_model(), _SIX), 1.1)
    return df.select("delivery_id", F.posexplode("p").alias("outcome", "p")).withColumn("p", F.round("p", 9))


@query("M2_relational_walk", _ensemble_sql())
def relational_walk(s: SparkSession, d: str) -> DataFrame:
    """The same probabilities from the trees as a table."""
    from pyspark.sql import Window as W

    from seamline.plans.registry import win_matrix

    z = mo.walked(win_matrix(s, d), "delivery_id", mo.parse_ensemble(synthetic_model(), _SIX)).withColumn("e", F.exp(F.col("margin") / 1.1))
    return z.select("delivery_id", F.col("output").alias("outcome"), F.round(F.col("e") / F.sum("e").over(W.partitionBy("delivery_id")), 9).alias("p"))


@query("S15_cached_pages", r"SELECT page_id, nullif(regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1), '') AS title, length(html)::INT AS n FROM pages WHERE html IS NOT NULL")
def cached_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages put into a cache by the batch, then all read from it by key, without a request."""
    pages = v.table(s, d, "pages").select(F.col("page_id").cast("string").alias("key"), "html").where("html IS NOT NULL")
    cache = scratch(s, "cache")
    batches = remote.requests(pages, "key", 25)
    bodies = batches.select("no", "request", F.explode("request").alias("key")).join(pages, "key").groupBy("no", "request").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "html")))).alias("body"))
    remote.stored(bodies, cache)
    got = remote.answers_by_key(remote.fetched(pages, "key", cache, size=25, readers=4, offline="true"))
    return got.select(F.col("key").cast("bigint").alias("page_id"), F.nullif(F.regexp_extract("value", r"(?is)<title[^>]*>([^<]*)", 1), F.lit("")).alias("title"), F.length("value").alias("n"))


# -- boosting

_WIN = ["need", "balls_left", "wickets_left", "required_rate", "current_rate", "venue_rate"]
#: The direction that each feature must take.
_WIN_SIGNS = {"need": -1, "balls_left": 1, "wickets_left": 1, "required_rate": -1}


def _fitted(s: SparkSession, d: str) -> tuple[DataFrame, bo.Fitted]:
    from seamline.operators.features import season_split
    from seamline.plans.registry import win_matrix

    ship(s)
    m = season_split(written(win_matrix(s, d), "features"), 1).withColumn("w", mo.recency_weight(F.col("season"))).withColumn("held", F.col("split") == "test")
    return m, bo.train(m, _WIN, weight="w", held_out="held", options=bo.Options(rounds=12, depth=3, rate=0.3, least=20, monotone=_WIN_SIGNS, patience=4))


@query("M4_train_win_model")
def train(s: SparkSession, d: str) -> DataFrame:
    m, fitted = _fitted(s, d)
    p = mo.score(m.where("held"), fitted.model).withColumn("p", mo.chase_rules(F.get("p", F.lit(0)), F.col("need"), F.col("balls_left"), F.col("wickets_left")))
    return mo.binary_scores(p, "p", "label")


@query("M4_B16_fitted_sweep", "SELECT feature, rising, 0::BIGINT AS violations FROM (VALUES ('need', false), ('balls', true), ('wickets', true)) t(feature, rising) WHERE EXISTS (SELECT 1 FROM events)")
def fitted_sweep(s: SparkSession, d: str) -> DataFrame:
    _, fitted = _fitted(s, d)
    g = mo.monotone_sweeps(s).withColumn("balls_left", F.col("balls")).withColumn("wickets_left", F.col("wickets")).withColumn("required_rate", 6 * F.col("need") / F.col("balls")).withColumn("current_rate", F.lit(7.5)).withColumn("venue_rate", F.lit(1.25))
    return mo.sweep_violations(mo.score(g, fitted.model).withColumn("p", F.get("p", F.lit(0))), "p")


_GAIN = "(({0}) * ({0}) / ({1} + 1.0))"


@query("M4_root_splits", f"""WITH m AS ({QUERIES["E3_S12_win_matrix"][1]}), t AS (SELECT avg(label::DOUBLE) AS p FROM m),
 v AS (SELECT 0 AS f, balls_left AS v, label FROM m UNION ALL SELECT 1, wickets_left, label FROM m), c AS (SELECT f, v, count(*) AS n, sum(label) AS y FROM v GROUP BY ALL),
 r AS (SELECT f, v, sum(n) OVER w AS n, sum(y) OVER w AS y, sum(n) OVER (PARTITION BY f) AS tn, sum(y) OVER (PARTITION BY f) AS ty FROM c WINDOW w AS (PARTITION BY f ORDER BY v)),
 g AS (SELECT f, v, 0.5 * ({_GAIN.format("n * p - y", "n * p * (1 - p)")} + {_GAIN.format("(tn - n) * p - (ty - y)", "(tn - n) * p * (1 - p)")} - {_GAIN.format("tn * p - ty", "tn * p * (1 - p)")}) AS gain FROM r, t WHERE n >= 20 AND tn - n >= 20)
 SELECT CASE f WHEN 0 THEN 'balls_left' ELSE 'wickets_left' END AS feature, round(max(gain), 3) AS gain FROM g GROUP BY f""")
def root_splits(s: SparkSession, d: str) -> DataFrame:
    from seamline.plans.registry import win_matrix

    ship(s)
    m = written(win_matrix(s, d), "features")
    # every value of these is a cut, so the best gain is that over all of them
    gains = [(f, round(bo.train(m, [f], options=bo.Options(rounds=1, depth=1, bins=200, least=20)).trees[0][0].gain[0], 3)) for f in ("balls_left", "wickets_left")]
    return _rows(s, gains, "feature string, gain double")


@query("M4_outcome_model")
def outcome_model(s: SparkSession, d: str) -> DataFrame:
    """Nine classes by thirty features: log loss of the last season by the prior and by the trees, a row a round."""
    from seamline.operators.features import FEATURES, season_split
    from seamline.plans.registry import features

    ship(s)
    # written once: the split, the cuts and the bins each read them
    m = season_split(written(features(s, d), "features"), 1).withColumn("held", F.col("split") == "test")
    fitted = bo.train(m, FEATURES, held_out="held", options=bo.Options(classes=9, rounds=5, depth=3, rate=0.3, least=50, bins=32))
    return _rows(s, [(i, round(x, 6), i == fitted.best) for i, x in enumerate(fitted.losses)], "round int, log_loss double, best boolean")
