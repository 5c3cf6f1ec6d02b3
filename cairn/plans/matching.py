"""Matching, text extraction, quotas, expiring records, offline plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.functions import geo, pages
from cairn.functions.text import CATEGORY_WORDS, CONTRADICTING, GENERIC_WORDS, distinctive
from cairn.operators import match
from cairn.operators.search import json_in
from cairn.operators.sideboxes import sideboxes
from cairn.plans.basics import SQL_TOKENS, hav
from cairn.plans.registry import query, table, view

#: Lists of words, written alike by Python and DuckDB.
CONFLICT, ALL_KINDS, GENERIC = {kind: str(words) for kind, words in CONTRADICTING.items()}, str(CATEGORY_WORDS), str(GENERIC_WORDS)
PLACED = f"""pairs AS (SELECT p.id, p.type, q.place_id, list_distinct({SQL_TOKENS.format('p.name')}) AS x, list_distinct({SQL_TOKENS.format('q.display_name')}) AS y, CAST(floor({hav('p.lng', 'p.lat', 'q.lng', 'q.lat')} + 0.5) AS BIGINT) AS metres
FROM v_pois p JOIN v_places q ON abs(p.lng - q.lng) < 0.01 AND abs(p.lat - q.lat) < 0.01 WHERE p.type IN ('hut', 'bivouac') AND p.name IS NOT NULL AND q.primary_type <> 'parking'),
gated AS (SELECT id, place_id, metres, CASE WHEN list_has_all(x, y) AND list_has_all(y, x) THEN 1 WHEN list_has_all(x, y) OR list_has_all(y, x) THEN 2 WHEN len(list_filter(x, lambda t: NOT list_contains({ALL_KINDS}, t))) > 0 AND list_has_all(y, list_filter(x, lambda t: NOT list_contains({ALL_KINDS}, t))) THEN 3 END AS tier
FROM pairs WHERE metres <= 300 AND NOT list_has_any(y, CASE type WHEN 'hut' THEN {CONFLICT['hut']} ELSE {CONFLICT['bivouac']} END))"""


def lodges(spark, d):
    return view(spark, d, "v_pois").filter("type in ('hut', 'bivouac') and name is not null").select("id", "type", "name", "lng", "lat")


def places(spark, d):
    return view(spark, d, "v_places").select("place_id", "display_name", "primary_type", F.col("lng").alias("other_lng"), F.col("lat").alias("other_lat"))


@query("JOIN-12", f"WITH {PLACED} SELECT id, place_id, metres, CAST(tier AS INTEGER) AS tier FROM gated WHERE tier IS NOT NULL")
def join_12(spark, d):
    return match.place_candidates(lodges(spark, d), places(spark, d)).select("id", "place_id", "metres", "tier")


CHOSEN = "chosen AS (SELECT id, place_id FROM (SELECT *, min(tier) OVER (PARTITION BY id) AS best, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY tier, metres, place_id) AS r FROM gated WHERE tier IS NOT NULL) WHERE r = 1 AND (best < 3 OR n = 1))"


@query("WIN-6", f"WITH {PLACED}, {CHOSEN} SELECT * FROM chosen")
def win_6(spark, d):
    return match.choose(match.place_candidates(lodges(spark, d), places(spark, d))).select("id", "place_id")


@query("JOIN-26", f"WITH {PLACED}, {CHOSEN} SELECT p.id, CASE WHEN p.type NOT IN ('hut', 'bivouac') OR p.name IS NULL THEN 'unavailable' WHEN p.id % 10 = 1 THEN 'not_found' WHEN c.place_id IS NOT NULL THEN 'found' ELSE 'not_found' END AS status FROM v_pois p LEFT JOIN chosen c ON c.id = p.id")
def join_26(spark, d):
    """Places with a cached absence (here id % 10 = 1) are not asked again."""
    chosen = match.choose(match.place_candidates(lodges(spark, d).filter("id % 10 <> 1"), places(spark, d))).select("id", "place_id")
    status = F.when(~F.col("type").isin("hut", "bivouac") | F.col("name").isNull(), "unavailable").when(F.col("place_id").isNotNull(), "found").otherwise("not_found")
    return view(spark, d, "v_pois").join(chosen, "id", "left").select("id", status.alias("status"))


HIGHLIGHTS = f"hl AS (SELECT place_id AS highlight_id, display_name AS title, lng, lat, place_id % 4 AS seq FROM v_places), hp AS (SELECT p.id, p.name, h.*, {hav('p.lng', 'p.lat', 'h.lng', 'h.lat')} AS dist FROM v_pois p JOIN hl h ON abs(p.lng - h.lng) < 0.1 AND abs(p.lat - h.lat) < 0.06 WHERE p.name IS NOT NULL)"
MATCHED = f"""hm AS (SELECT id, highlight_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, seq, highlight_id) AS r FROM (SELECT *, CASE WHEN dist <= 300 THEN 0 WHEN dist <= 800 THEN 1 ELSE 2 END AS tier FROM hp WHERE dist <= 2000 AND (contains(lower(title), lower(name)) OR contains(lower(name), lower(title)) OR len(list_filter(string_split(lower(name), ' '), lambda w: length(w) >= 5 AND NOT list_contains({GENERIC}, w) AND contains(lower(title), w))) > 0))) WHERE r = 1)"""


def highlights(spark, d):
    return view(spark, d, "v_places").selectExpr("place_id as highlight_id", "display_name as title", "place_id % 4 as seq", "lng as other_lng", "lat as other_lat")


@query("JOIN-14", f"WITH {HIGHLIGHTS}, {MATCHED} SELECT id, highlight_id, CAST(tier AS INTEGER) AS tier FROM hm")
def join_14(spark, d):
    return match.highlight_match(view(spark, d, "v_pois").select("id", "name", "lng", "lat"), highlights(spark, d))


@query("JOIN-15", f"""WITH {HIGHLIGHTS}, {MATCHED}, o AS (SELECT hp.*, row_number() OVER (PARTITION BY hp.id ORDER BY CASE WHEN len(list_filter(string_split(lower(name), ' '), lambda w: length(w) >= 4 AND contains(lower(title), w))) > 0 THEN 0 ELSE 1 END, seq, hp.highlight_id) AS r FROM hp LEFT JOIN hm ON hm.id = hp.id WHERE dist <= 5000 AND (hm.highlight_id IS NULL OR hm.highlight_id <> hp.highlight_id))
SELECT id, arg_min(highlight_id, r) AS highlight_id FROM o WHERE r <= 6 AND highlight_id % 3 = 0 GROUP BY id""")
def join_15(spark, d):
    pois = view(spark, d, "v_pois").filter("name is not null").select("id", "name", "lng", "lat")
    own = match.highlight_match(pois, highlights(spark, d))
    return match.fallback_highlight(pois, highlights(spark, d), own, highlights(spark, d).filter("highlight_id % 3 = 0"))


@query("JOIN-13", """WITH idx AS (SELECT p_name AS text, 'http://x/' || replace(p_name, ' ', '-') || '.html' AS url, min(p_partkey) AS pos FROM part GROUP BY p_name),
o AS (SELECT id, regexp_replace(lower(name), '^(rifugio|bivacco|bivouac)\\s+', '') AS bare FROM v_pois WHERE name IS NOT NULL),
s AS (SELECT id, url, pos, CASE WHEN text = bare THEN 2.0 WHEN len(w) > 0 AND len(list_filter(w, lambda x: NOT contains(replace(text, ' ', '-'), x))) = 0 THEN 1.0 WHEN len(list_filter(w, lambda x: contains(text, x))) > 0 THEN 0.5 END AS score FROM (SELECT *, list_filter(string_split(bare, ' '), lambda x: length(x) >= 4) AS w FROM o) CROSS JOIN idx)
SELECT id, url, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS r FROM s WHERE score IS NOT NULL) WHERE r = 1""")
def join_13(spark, d):
    index = table(spark, d, "part").groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("pos")).withColumn("url", F.concat(F.lit("http://x/"), F.replace("text", F.lit(" "), F.lit("-")), F.lit(".html")))
    return match.index_match(view(spark, d, "v_pois"), index)


@query("JOIN-16", """WITH posts AS (SELECT place_id AS post_id, 'Ieri al ' || display_name || '!' AS post FROM v_places),
o AS (SELECT id, name, list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda t: length(t) >= 2 AND t NOT IN ('rifugio', 'bivacco', 'monte')) AS core FROM v_pois WHERE name IS NOT NULL)
SELECT DISTINCT id, post_id FROM o JOIN posts ON contains(lower(post), lower(name)) OR list_has_all(string_split_regex(lower(post), '[^a-z0-9]+'), core)""")
def join_16(spark, d):
    posts = view(spark, d, "v_places").select(F.col("place_id").alias("post_id"), F.concat(F.lit("Ieri al "), "display_name", F.lit("!")).alias("post"))
    return match.relevant_posts(view(spark, d, "v_pois").select("id", "type", "name"), posts)


NOW = "TIMESTAMP '2024-01-20 00:00:00'"


@query("JOIN-18", f"WITH live AS (SELECT cache_key, max(event_id) AS event_id FROM v_cache WHERE expires_at > {NOW} GROUP BY cache_key) SELECT s_suppkey AS k, event_id, event_id IS NOT NULL AS hit FROM supplier LEFT JOIN live ON cache_key = s_suppkey")
def join_18(spark, d):
    live = view(spark, d, "v_cache").filter(f"expires_at > {NOW}").groupBy("cache_key").agg(F.max("event_id").alias("event_id"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).join(live, F.col("k") == F.col("cache_key"), "left").select("k", "event_id", F.col("event_id").isNotNull().alias("hit"))


@query("JOIN-19", f"SELECT user_id, event_id FROM events WHERE event_type IN ('view', 'error') AND (event_type = 'view' OR ts > {NOW} - INTERVAL '7' DAY)")
def join_19(spark, d):
    e = table(spark, d, "events").filter("event_type in ('view', 'error')").withColumn("place_id", F.when(F.col("event_type") == "view", F.col("event_id")))
    return e.filter(f"place_id is not null or ts > {NOW} - interval '7' day").select("user_id", "event_id")


@query("JOIN-20", f"""WITH lab AS (SELECT p.id, q.place_id, 0 AS via FROM v_pois p JOIN v_places q ON lower(p.name) = lower(q.display_name)),
near AS (SELECT p.id, q.place_id, 1 AS via FROM v_pois p JOIN v_places q ON abs(p.lng - q.lng) < 0.03 AND abs(p.lat - q.lat) < 0.02 WHERE {hav('p.lng', 'p.lat', 'q.lng', 'q.lat')} <= 1000 AND p.id NOT IN (SELECT id FROM lab))
SELECT id, place_id, via FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place_id) AS r FROM (SELECT * FROM lab UNION ALL SELECT * FROM near)) WHERE r <= 3""")
def join_20(spark, d):
    return match.labelled(view(spark, d, "v_pois").select("id", "name", "lng", "lat"), places(spark, d))


@query("JOIN-21", "SELECT a.conv_id, a.turn, coalesce(b.text, a.text) AS told FROM conversations a LEFT JOIN (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE turn IN (1, 2)) b USING (conv_id, turn)")
def join_21(spark, d):
    c = table(spark, d, "conversations")
    full = c.filter("turn in (1, 2)").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("full"))
    return c.join(full, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("full", "text").alias("told"))


QUOTA = "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY month ORDER BY ts, event_id) AS m FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) AS dr FROM v_quota_calls) WHERE dr <= 150) WHERE m <= 4000"


@query("WIN-10", QUOTA)
def win_10(spark, d):
    return match.admitted(view(spark, d, "v_quota_calls"), month=4000).select("event_id")


@query("WIN-11", f"WITH ok AS ({QUOTA}), e AS (SELECT ts FROM events JOIN ok USING (event_id)) SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) AS calls FROM e GROUP BY 1 UNION ALL SELECT strftime(ts, '%Y-%m'), count(*) FROM e GROUP BY 1")
def win_11(spark, d):
    ok = match.admitted(view(spark, d, "v_quota_calls"), month=4000)
    period = F.explode(F.array(F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "yyyy-MM")))
    return ok.select(period.alias("period")).groupBy("period").agg(F.count("*").alias("calls"))


@query("AGG-13", "SELECT url, count(*) AS n FROM (SELECT unnest([user_id % 50, user_id % 20]) AS url FROM events) GROUP BY url")
def agg_13(spark, d):
    urls = F.explode(F.array(F.col("user_id") % 50, F.col("user_id") % 20))
    return table(spark, d, "events").select(urls.alias("url")).groupBy("url").agg(F.count("*").alias("n"))


Y = "CAST(floor((1 - ln(tan(radians({0})) + 1 / cos(radians({0}))) / pi()) / 2 * pow(2.0, z)) AS BIGINT)"
TILES = f"t AS (SELECT request_id, z, CAST(floor((minx + 180) / 360 * pow(2.0, z)) AS BIGINT) AS x0, CAST(floor((maxx + 180) / 360 * pow(2.0, z)) AS BIGINT) AS x1, {Y.format('maxy')} AS y0, {Y.format('miny')} AS y1 FROM v_bbox_requests CROSS JOIN (SELECT CAST(unnest(range(8, 13)) AS INTEGER) AS z))"


def tile_ranges(spark, d, low: int = 8, high: int = 12):
    b = view(spark, d, "v_bbox_requests").withColumn("z", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return b.select("request_id", "z", geo.tile_x("minx", "z").alias("x0"), geo.tile_x("maxx", "z").alias("x1"), geo.tile_y("maxy", "z").alias("y0"), geo.tile_y("miny", "z").alias("y1"))


def tiles(spark, d):
    t = tile_ranges(spark, d).withColumn("x", F.explode(F.sequence("x0", "x1")))
    return t.withColumn("y", F.explode(F.sequence("y0", "y1"))).select("request_id", "z", "x", "y")


@query("TGF-1", f"WITH {TILES} SELECT request_id, z, x, y FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM t) CROSS JOIN LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y)")
def tgf_1(spark, d):
    return tiles(spark, d)


@query("TGF-2", f"""WITH {TILES}, e AS (SELECT request_id, z, x, y, row_number() OVER (PARTITION BY request_id ORDER BY z, x, y) - 1 AS i FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM t) CROSS JOIN LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y))
SELECT request_id, 'https://' || CASE i % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END || '.tile.openstreetmap.org/' || CAST(z AS STRING) || '/' || CAST(x AS STRING) || '/' || CAST(y AS STRING) || '.png' AS url FROM e""")
def tgf_2(spark, d):
    i = F.row_number().over(Window.partitionBy("request_id").orderBy("z", "x", "y")) - 1
    host = F.element_at(F.array(*map(F.lit, "abc")), (i % 3 + 1).cast("int"))
    return tiles(spark, d).select("request_id", F.concat(F.lit("https://"), host, F.lit(".tile.openstreetmap.org/"), F.concat_ws("/", "z", "x", "y"), F.lit(".png")).alias("url"))


@query("AGG-14", f"WITH {TILES} SELECT request_id, CAST(sum((x1 - x0 + 1) * (y1 - y0 + 1)) AS BIGINT) AS tiles, CAST(sum((x1 - x0 + 1) * (y1 - y0 + 1)) * 18000 + 200000 AS BIGINT) AS bytes FROM t GROUP BY request_id")
def agg_14(spark, d):
    n = F.sum((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1))
    return tile_ranges(spark, d).groupBy("request_id").agg(n.alias("tiles"), (n * 18000 + 200000).alias("bytes"))


@query("AGG-15", "SELECT user_id, round(count_if(event_type = 'error') / count(*), 9) AS rate, count_if(event_type = 'error') / count(*) > 0.05 AS rejected FROM events GROUP BY user_id")
def agg_15(spark, d):
    rate = F.count_if(F.col("event_type") == "error") / F.count("*")
    return table(spark, d, "events").groupBy("user_id").agg(F.round(rate, 9).alias("rate"), (rate > 0.05).alias("rejected"))


@query("AGG-17", "SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS sources FROM events WHERE event_type <> 'error' GROUP BY user_id")
def agg_17(spark, d):
    seen = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    return table(spark, d, "events").filter("event_type <> 'error'").groupBy("user_id").agg(F.array_join(seen, ",").alias("sources"))


@query("AGG-18", r"""SELECT id, concat_ws(chr(10), 'Nome: ' || name, 'Tipo: ' || type, 'Altitudine: ' || CAST(elevation AS STRING) || 'm s.l.m.', printf('Coordinate: %.5fN, %.5fE', CAST(lat AS DOUBLE), CAST(lng AS DOUBLE))) ||
coalesce(chr(10) || chr(10) || '--- DATI RACCOLTI ---' || s, chr(10) || chr(10) || '(Nessun dato aggiuntivo disponibile da fonti esterne.)') || chr(10) || chr(10) || 'Genera ora la descrizione completa seguendo le istruzioni.' AS message
FROM v_pois LEFT JOIN (SELECT near_poi AS id, string_agg(chr(10) || '=== MAPS ===' || chr(10) || display_name, chr(10) ORDER BY place_id) AS s FROM v_places WHERE primary_type <> 'parking' GROUP BY near_poi) USING (id)""")
def agg_18(spark, d):
    results = view(spark, d, "v_places").selectExpr("near_poi as id", "place_id as ord", "'maps' as source", "display_name as content", "primary_type <> 'parking' as success")
    return match.dossier(view(spark, d, "v_pois"), results)


@query("AGG-19", """SELECT type, CAST(sum(length('{"osm_id":' || CAST(osm_id AS STRING) || ',"type":"' || type || '"}')) AS BIGINT) AS bytes FROM v_pois GROUP BY type""")
def agg_19(spark, d):
    return view(spark, d, "v_pois").groupBy("type").agg(F.sum(F.length(F.to_json(F.struct("osm_id", "type")))).alias("bytes"))


@query("AGG-20", r"SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages")
def agg_20(spark, d):
    return table(spark, d, "pages").select(F.try_parse_url("url", F.lit("HOST")).alias("host")).distinct()


LINKS = r"""l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\b[^>]*?href="[^"]*"[^>]*>.*?</a>', 0, 'is')) AS a FROM pages), li AS (SELECT page_id, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_replace(a, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM l)"""


@query("TXT-1", f"WITH {LINKS} SELECT page_id, href, text FROM li WHERE length(text) > 2")
def txt_1(spark, d):
    return pages.links(table(spark, d, "pages")).filter(F.length("text") > 2).select("page_id", "href", "text")


@query("TXT-2", r"""WITH h AS (SELECT page_id, list_filter(regexp_extract_all(html, '<a\b[^>]*?href="([^"]*)"[^>]*>.*?</a>', 1, 'is'), lambda x: starts_with(x, '/t')) AS l FROM pages) SELECT page_id, 'http://site.example' || l[1] AS url FROM h WHERE len(l) > 0""")
def txt_2(spark, d):
    """Each page's links, behind a search engine's redirect: the first that leads where it should."""
    link = F.concat(F.lit("http://site.example"), "href")
    wrapped = F.concat(F.lit("//lite.example/l/?kh=1&uddg="), F.url_encode(link), F.lit("&rut=1"))
    found = pages.links(table(spark, d, "pages")).withColumn("url", pages.unwrapped(wrapped))
    return found.filter(F.col("url").startswith("http://site.example/t")).groupBy("page_id").agg(F.min_by("url", "pos").alias("url"))


@query("TXT-3", "SELECT page_id, 'tel. ' || CAST(page_id AS STRING) || chr(10) || 'Accesso — da Nord Tempo: 02:' || CAST(10 + page_id % 50 AS STRING) AS told FROM pages")
def txt_3(spark, d):
    """Boxes put into each page's side bar."""
    id_ = F.col("page_id").cast("string")
    box = lambda title, *content: F.concat(F.lit(f'<div class="sidebox"><h4 class="boxtitle">{title}</h4><div class="boxcontent">'), *content, F.lit("</div></div>"))
    ways = F.concat(F.lit('<div class="approach-data">da <b>Nord</b> Tempo: 02:'), (10 + F.col("page_id") % 50).cast("string"), F.lit('</div><div class="approach-data">da Sud Tempo: 00:00</div><div class="approach-data">da Est</div>'))
    bar = F.concat(box("Contatti del rifugio", F.lit("tel.  "), id_, F.lit('<a href="https://facebook.com/x">social</a>')), box("Accesso al rifugio", ways), box("Meteo", F.lit("sole")))
    return sideboxes(table(spark, d, "pages").select("page_id", F.concat("html", bar).alias("html")))


@query("TXT-4", r"""SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(bare, '<article\b[^>]*>(.*)</article>', 1, 'is'), ''), bare), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM
(SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gis'), '<script\b.*?</script>', ' ', 'gis'), '<style\b.*?</style>', ' ', 'gis'), '<(nav|footer|header|aside)\b.*?</(nav|footer|header|aside)>', ' ', 'gis') AS bare FROM pages)""")
def txt_4(spark, d):
    return table(spark, d, "pages").select("page_id", pages.main_text("html").alias("text"))


@query("TXT-5", "SELECT page_id, concat_ws(' | ', CASE WHEN page_id % 3 > 0 THEN 'Dislivello: ' || length(html) || ' m' END, 'Lunghezza: ' || page_id || ',5 km') AS stats FROM pages")
def txt_5(spark, d):
    """Figures put behind each whole page."""
    climb = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("<p>Dislivello: <b>"), F.length("html").cast("string"), F.lit("</b>&nbsp;m</p>"))).otherwise("")
    html = F.concat("html", climb, F.lit("<i>Lunghezza "), F.col("page_id").cast("string"), F.lit(",5 km</i>"))
    return table(spark, d, "pages").select("page_id", pages.stats(html).alias("stats"))


@query("TXT-6", r"SELECT doc_id, substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 1200) AS told FROM documents")
def txt_6(spark, d):
    text = F.concat(F.lit("PARCHEGGIO: in piazza\n\n"), "text", F.lit("\n\nautostrada  uscita Nord"))
    return table(spark, d, "documents").select("doc_id", pages.useful_paragraphs(text).alias("told"))


@query("TXT-7", r"""WITH q AS (SELECT conv_id, turn, turn % 3 = 2 OR regexp_matches(text, 'terrain|expect|highlight|viewpoint|landmark|wildlife|flora|scenery|feature', 'i') AS useful, text AS question, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS answer FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY useful DESC, turn, question, answer) AS k FROM (SELECT conv_id, min(turn) AS turn, bool_or(useful) AS useful, question, answer FROM q WHERE answer IS NOT NULL GROUP BY ALL))
SELECT conv_id, string_agg(substring(trim(regexp_replace(answer, '\s+', ' ', 'g')), 1, 600), chr(10) ORDER BY k) AS told FROM r WHERE k <= 2 GROUP BY conv_id""")
def txt_7(spark, d):
    """Each turn asks, the one after it answers; every third one is about the view."""
    said = table(spark, d, "conversations")
    turns = said.withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "text"))).filter("answer IS NOT NULL")
    question = F.concat(F.when(F.col("turn") % 3 == 2, "Which viewpoint? ").otherwise(""), "text")
    faq = turns.select("conv_id", F.struct("turn", question.alias("question"), F.concat(F.lit("<b>"), "answer", F.lit("</b>")).alias("answer")).alias("f"))
    listed = faq.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: F.struct(f["question"].alias("question"), f["answer"].alias("answer"))).alias("faq"))
    return listed.select("conv_id", pages.two_answers("faq").alias("told"))


@query("TXT-8", "SELECT conv_id, turn, '<p>' || replace(text, '<', '') || '</p>' AS clean FROM conversations")
def txt_8(spark, d):
    """Each turn as a paragraph, after a thought and a preface, in a code fence."""
    plain = F.replace("text", F.lit("<"), F.lit(""))
    raw = F.concat(F.lit("<think>"), plain, F.lit("</think>\n```html\nBene: <p>"), plain, F.lit("</p>\n```"))
    return table(spark, d, "conversations").select("conv_id", "turn", pages.sanitised(raw).alias("clean"))


@query("TXT-9", "SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events")
def txt_9(spark, d):
    prose = F.concat(F.lit("Ecco il filtro: "), "props", F.lit(" (fine)."))
    return table(spark, d, "events").select("event_id", F.from_json(json_in(prose), "k bigint")["k"].alias("k"))


@query("TXT-10", "SELECT event_id, event_type || ' (' || strftime(ts, '%Y-%m') || '): ' || printf('%.2f', value) AS line FROM events")
def txt_10(spark, d):
    line = F.concat("event_type", F.lit(" ("), F.date_format("ts", "yyyy-MM"), F.lit("): "), F.format_string("%.2f", "value"))
    return table(spark, d, "events").select("event_id", line.alias("line"))


@query("TXT-11", """SELECT id, CASE WHEN id % 3 = 0 AND name IS NOT NULL THEN chr(10) || '<h3>Google Maps</h3>' || chr(10) || '<p class="gmaps-row"><a href="http://m?q=' || name || '&amp;id=' || id || '">Apri link Google Maps</a></p>' WHEN id % 3 = 1 THEN chr(10) || '<h3>Google Maps</h3>' || chr(10) || '<p>Nessun link Google Maps disponibile.</p>' ELSE '' END AS block FROM v_pois""")
def txt_11(spark, d):
    status = F.when(F.col("id") % 3 == 0, "found").when(F.col("id") % 3 == 1, "not_found").otherwise("unavailable")
    url = F.concat(F.lit("http://m?q="), "name", F.lit("&id="), F.col("id").cast("string"))
    return view(spark, d, "v_pois").select("id", pages.link_block(status, url).alias("block"))


@query("TXT-12", r"SELECT doc_id, CASE WHEN length(text) > 300 THEN substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 1200) WHEN doc_id % 2 = 0 THEN 'faq' ELSE text END AS told FROM documents")
def txt_12(spark, d):
    return table(spark, d, "documents").select("doc_id", pages.richest("text", F.when(F.col("doc_id") % 2 == 0, "faq")).alias("told"))


@query("SCL-28", "SELECT id, replace(replace('https://t/{z}/{x}.png', '{z}', '14'), '{x}', CAST(id AS STRING)) AS url FROM v_pois")
def scl_28(spark, d):
    url = F.replace(F.replace(F.lit("https://t/{z}/{x}.png"), F.lit("{z}"), F.lit("14")), F.lit("{x}"), F.col("id").cast("string"))
    return view(spark, d, "v_pois").select("id", url.alias("url"))


@query("SCL-29", "SELECT page_id, replace(url, 'http://', 'https://') AS url FROM pages")
def scl_29(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^http://", "https://").alias("url"))


@query("SCL-30", "SELECT id, CASE type WHEN 'hut' THEN 'rifugio ' || name WHEN 'bivouac' THEN 'bivacco ' || name ELSE name || ' escursione' END AS q FROM v_pois")
def scl_30(spark, d):
    q = F.when(F.col("type") == "hut", F.concat(F.lit("rifugio "), "name")).when(F.col("type") == "bivouac", F.concat(F.lit("bivacco "), "name")).otherwise(F.concat("name", F.lit(" escursione")))
    return view(spark, d, "v_pois").select("id", q.alias("q"))


@query("SCL-31", "SELECT request_id, CASE request_id % 3 WHEN 0 THEN 'opentopo-tiles' WHEN 1 THEN 'osm-tiles' ELSE 'mapbox-tiles' END AS cache FROM v_bbox_requests")
def scl_31(spark, d):
    base = F.element_at(F.array(*map(F.lit, ("opentopo", "osm", "mapbox"))), (F.col("request_id") % 3 + 1).cast("int"))
    caches = F.create_map(*[F.lit(x) for n in ("opentopo", "osm", "mapbox") for x in (n, f"{n}-tiles")])
    return view(spark, d, "v_bbox_requests").select("request_id", F.element_at(caches, base).alias("cache"))


@query("SCL-34", f"SELECT place_id, array_to_string(list_filter({SQL_TOKENS.format('display_name')}, lambda t: NOT list_contains({ALL_KINDS}, t)), ' ') AS second FROM v_places")
def scl_34(spark, d):
    name = F.col("display_name")
    variants = F.filter(F.array(name, F.array_join(distinctive(name), " ")), lambda v: v != "")
    return view(spark, d, "v_places").select("place_id", F.posexplode(variants).alias("p", "second")).filter("p = 1").select("place_id", "second")


@query("SCL-36", "SELECT osm_id, 'https://www.openstreetmap.org/way/' || CAST(osm_id AS STRING) AS url FROM v_trails_attr")
def scl_36(spark, d):
    return view(spark, d, "v_trails_attr").select("osm_id", F.concat(F.lit("https://www.openstreetmap.org/way/"), F.col("osm_id").cast("string")).alias("url"))


@query("TGF-4", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
def tgf_4(spark, d):
    s = table(spark, d, "supplier")
    a, b = s.select("s_nationkey", F.col("s_suppkey").alias("a")), s.select("s_nationkey", F.col("s_suppkey").alias("b"))
    return a.join(b, "s_nationkey").filter("a <> b").select("a", "b")


@query("TGF-5", "SELECT near_poi, place_id FROM v_places")
def tgf_5(spark, d):
    packed = view(spark, d, "v_places").groupBy("near_poi").agg(F.collect_list("place_id").alias("items"))
    return packed.select("near_poi", F.explode_outer("items").alias("place_id"))
