"""Queries that shape records, names, phrases and answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.functions import phrases
from rankloom.operators import ranks

from .catalogue import table
from .registry import query

STOP = ("the", "and", "that", "with", "this", "for", "from")
#: A model's id as in a catalogue: author/name-size-tuning, without an author for every fifth part.
MODEL_ID = """CASE WHEN p_partkey % 5 = 0 THEN '' ELSE replace(p_brand, '#', '') || '/' END || string_split(p_name, ' ')[1] || upper(substr(string_split(p_name, ' ')[2], 1, 1)) || substr(string_split(p_name, ' ')[2], 2) || '-' || p_size || 'b-' || CASE p_partkey % 3 WHEN 0 THEN 'chat' WHEN 1 THEN 'instruct' ELSE 'x' END"""


def model_ids(spark, d):
    first, second = F.substring_index("p_name", " ", 1), F.split("p_name", " ")[1]
    author = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/")))
    tuning = F.when(F.col("p_partkey") % 3 == 0, "chat").when(F.col("p_partkey") % 3 == 1, "instruct").otherwise("x")
    return table(spark, d, "part").withColumn("model_id", F.concat(author, first, F.upper(F.substring(second, 1, 1)), F.expr("substring(split(p_name, ' ')[1], 2)"), F.lit("-"), F.col("p_size"), F.lit("b-"), tuning))


@query(f"""WITH m AS (SELECT p_partkey, {MODEL_ID} AS model_id FROM part)
    SELECT 'M_' || row_number() OVER (ORDER BY p_partkey) AS key, CASE WHEN contains(model_id, '/') THEN split_part(model_id, '/', 1) ELSE 'Unknown' END AS author, CASE WHEN contains(model_id, '/') THEN split_part(model_id, '/', 2) ELSE model_id END AS name, 1 AS n_ids FROM m""")
def synthetic_keys(spark, d):
    """Author and name, a key M_1, M_2, ... in order of the part; a scalar as a list of one."""
    m = ranks.ranked(model_ids(spark, d), "p_partkey", [], "nth")
    c = F.col("model_id")
    return m.select(F.concat(F.lit("M_"), "nth").alias("key"), phrases.author_of(c).alias("author"), phrases.after_slash(c).alias("name"), F.size(F.array(c)).alias("n_ids"))


@query(f"""WITH m AS (SELECT p_partkey, split_part({MODEL_ID}, '/', -1) AS n FROM part), w AS (SELECT p_partkey, n, regexp_extract_all(lower(regexp_replace(regexp_replace(n, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+') AS w FROM m)
    SELECT p_partkey, array_to_string(list_filter(w, lambda x: x NOT IN ('chat', 'instruct', 'base', 'code', 'mini') AND NOT regexp_full_match(x, '[0-9]+b?')), ' ') AS family, TRY_CAST(nullif(regexp_extract(n, '(?:^|[^a-z0-9])([0-9]+)b(?:$|[^a-z0-9])', 1), '') AS BIGINT) AS billions, list_filter(w, lambda x: x IN ('chat', 'instruct', 'base', 'code', 'mini'))[1] AS tuning FROM w""")
def name_variants(spark, d):
    family, size, tuning = phrases.name_parts(phrases.after_slash(F.col("model_id")))
    return model_ids(spark, d).select("p_partkey", family.alias("family"), size.alias("billions"), tuning.alias("tuning"))


@query(f"""WITH m AS (SELECT p_partkey, lower({MODEL_ID}) AS m FROM part), n AS (SELECT p_partkey, m, regexp_replace(m, '^[^/]*/', '') AS n FROM m)
    SELECT p_partkey, array_to_string(list_sort(list_distinct([m, n, regexp_replace(n, '[-_.]+', ' ', 'g'), regexp_replace(m, '/', ' ', 'g')])), '|') AS mentions, regexp_matches('a ' || replace(n, '-', '_') || ' b', '\\b' || array_to_string(regexp_extract_all(n, '[a-z0-9]+'), '[ _-]?') || '\\b') AS found FROM n""")
def mention_patterns(spark, d):
    """The ways to mention a model, and whether its separator-tolerant pattern finds one of them."""
    name = phrases.after_slash(F.lower("model_id"))
    text = F.concat(F.lit("a "), F.replace(name, F.lit("-"), F.lit("_")), F.lit(" b"))
    return model_ids(spark, d).select("p_partkey", F.array_join(phrases.mention_variants(F.col("model_id")), "|").alias("mentions"), F.regexp_like(text, phrases.tolerant_pattern(name)).alias("found"))


@query("""WITH a AS (SELECT DISTINCT p_type AS full_name, substr(p_type, 1, 4) AS abbr FROM part), p AS (SELECT p_partkey, p_name || ' (' || substr(p_type, 1, 4) || ')' AS label FROM part)
    SELECT p_partkey, CASE WHEN full_name IS NULL THEN label ELSE full_name || ' (' || abbr || ')' END AS expanded, regexp_extract(label, '^(.*?) \\(', 1) || '|' || abbr || '|' || regexp_extract(label, '^(.*?) \\(', 1) || ' ' || abbr AS variants FROM p LEFT JOIN a ON abbr = regexp_extract(label, '\\(([A-Z]{2,8})\\)$', 1)""")
def abbreviation_rewrite(spark, d):
    """'label (ABBR)' as 'Expansion (ABBR)' by a table of abbreviations, and the variants of the phrase."""
    part = table(spark, d, "part")
    known = part.select(F.col("p_type").alias("full_name"), F.substring("p_type", 1, 4).alias("abbr")).distinct()
    p = part.select("p_partkey", F.concat("p_name", F.lit(" ("), F.substring("p_type", 1, 4), F.lit(")")).alias("label")).withColumn("abbr", F.regexp_extract("label", r"\(([A-Z]{2,8})\)$", 1))
    return p.join(known, "abbr", "left").select("p_partkey", F.coalesce(F.concat("full_name", F.lit(" ("), "abbr", F.lit(")")), "label").alias("expanded"), F.array_join(phrases.phrase_variants(F.col("label")), "|").alias("variants"))


@query("""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM conversations), a AS (SELECT *, unnest(['TAO', 'EN', 'LI']) AS acronym FROM w), i AS (SELECT *, instr(array_to_string(list_transform(w, lambda x: x[1]), ''), lower(acronym)) AS pos FROM a)
    SELECT conv_id, turn, acronym, array_to_string(list_slice(w, pos, pos + length(acronym) - 1), ' ') AS expansion FROM i WHERE pos > 0""")
def acronym_expansion(spark, d):
    """The first run of words of a turn whose initials spell an acronym."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0)).alias("w"), F.explode(F.array(*map(F.lit, ("TAO", "EN", "LI")))).alias("acronym"))
    return c.select("conv_id", "turn", "acronym", phrases.expansion(F.col("w"), F.col("acronym")).alias("expansion")).filter("expansion IS NOT NULL")


@query(r"""WITH t AS (SELECT item_id, regexp_replace('The ' || text, ' ', '_', 'g') AS p FROM benchmark), w AS (SELECT item_id, list_filter(string_split(regexp_replace(p, '[-_\s]+', ' ', 'g'), ' '), lambda x: length(x) > 0) AS w FROM t),
    l AS (SELECT item_id, list_transform(w, lambda x: CASE WHEN regexp_full_match(x, '[A-Z][A-Z0-9]+') THEN x ELSE lower(x) END) AS w FROM w)
    SELECT item_id, regexp_replace(array_to_string(list_filter(w, lambda x, i: i > 1 OR x NOT IN ('the', 'a', 'an', 'this', 'that', 'these', 'those', 'some', 'any')), ' '), '([a-z]{2,}[^s])s$', '\1') AS phrase FROM l""")
def phrase_canonical(spark, d):
    """Phrases with underscores and a determiner in their canonical form."""
    p = F.regexp_replace(F.concat(F.lit("The "), "text"), " ", "_")
    return table(spark, d, "benchmark").select("item_id", phrases.canonical_phrase(p).alias("phrase"))


@query(r"""SELECT p_partkey, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace('task: ' || p_name || ' (' || p_size || ' mm) / ' || p_type || ' models', '\([^()]*\)', ' ', 'g'), '^[^:]{1,20}:\s*', ''), '[\s/|,;]+', ' ', 'g')), ' (model|models|task|tasks|system|systems)$', '') AS phrase FROM part""")
def phrase_compact(spark, d):
    c = F.concat(F.lit("task: "), "p_name", F.lit(" ("), "p_size", F.lit(" mm) / "), "p_type", F.lit(" models"))
    return table(spark, d, "part").select("p_partkey", phrases.compact_phrase(c).alias("phrase"))


@query("""SELECT conv_id, turn, CASE WHEN instr(lower(text), 'ene') > 0 THEN substr(text, greatest(instr(lower(text), 'ene') - 30, 1), instr(lower(text), 'ene') - greatest(instr(lower(text), 'ene') - 30, 1) + 33) ELSE substr(text, 1, 60) END AS snippet FROM conversations""")
def name_snippets(spark, d):
    """30 characters around the first mention of a name, else the start: the length is the feature."""
    return table(spark, d, "conversations").select("conv_id", "turn", phrases.snippet(F.col("text"), F.lit("ene"), 30).alias("snippet"))


@query("""WITH s AS (SELECT doc_id, list_prepend('', list_filter(string_split(coalesce(text, ''), '. '), lambda p: length(p) > 0)) AS p FROM documents), c AS (SELECT doc_id, string_split(list_reduce(p, lambda acc, x: CASE WHEN acc = '' THEN x WHEN length(string_split(acc, chr(31))[-1]) + 1 + length(x) <= 400 THEN acc || chr(10) || x ELSE acc || chr(31) || x END), chr(31)) AS c FROM s)
    SELECT doc_id, len(c) AS n_chunks, list_max(list_transform(c, lambda x: length(x))) AS longest, md5(array_to_string(c, chr(31))) AS chunks_md5 FROM c""")
def paragraph_chunks(spark, d):
    """Sentences of whole texts joined greedily into chunks of 400 characters."""
    c = table(spark, d, "documents").select("doc_id", phrases.chunks(F.split(F.coalesce("text", F.lit("")), r"\. "), 400).alias("c"))
    return c.select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.array_max(F.transform("c", F.length)).cast("long").alias("longest"), F.md5(F.array_join("c", "\x1f")).alias("chunks_md5"))


@query(r"""WITH l AS (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^[\s|:+=-]{3,}$|^\s*(Traceback|File "|at [\w.$]+\()') AND length(regexp_replace(x, '[^0-9]', '', 'g')) * 2 <= length(x)), chr(10)) AS t FROM documents)
    SELECT doc_id, md5(regexp_replace(regexp_replace(t, 'https?://[^\s]+', '[URL]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g')) AS clean_md5, length(t)::BIGINT AS n_chars FROM l""")
def description_cleaner(spark, d):
    kept = F.array_join(phrases.kept_lines(F.col("text")), "\n")
    return table(spark, d, "documents").select("doc_id", F.md5(phrases.clean_lines(F.col("text"))).alias("clean_md5"), F.length(kept).cast("long").alias("n_chars"))


@query("""WITH w AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: x IN ('no', 'not', 'never') OR x NOT IN ('the', 'and', 'that', 'with', 'this', 'for', 'from')) AS w FROM conversations)
    SELECT conv_id, turn, array_to_string(list_transform(w, lambda x: regexp_replace(x, '^([a-z]{3,}[^s])s$', '\\1')), ' ') AS words FROM w""")
def content_lemmas(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(phrases.content_words(F.col("text"), STOP), " ").alias("words"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || upper(p_name) || ' ' || lower(p_type), ' ') AS w FROM part) SELECT p_partkey, array_to_string(list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i), ' ') AS items FROM w""")
def unique_first_seen(spark, d):
    w = F.split(F.concat_ws(" ", "p_name", F.upper("p_name"), F.lower("p_type")), " ")
    return table(spark, d, "part").withColumn("w", w).select("p_partkey", F.array_join(phrases.first_seen(F.col("w")), " ").alias("items"))


@query(r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS b FROM pages), h AS (SELECT page_id, b, regexp_extract(b, '^[A-Za-z]+://[^/]*') AS h FROM b)
    SELECT page_id, lower(h) || substr(b, length(h) + 1) AS url, nullif(regexp_extract(b, '^[A-Za-z]+://[^/]+/([^/]+)/([^/]+)', 1) || '/' || regexp_extract(b, '^[A-Za-z]+://[^/]+/([^/]+)/([^/]+)', 2), '/') AS slug FROM h""")
def url_slugs(spark, d):
    """Addresses without query and fragment, and the first two parts of their path."""
    part = lambda k: F.regexp_extract("b", r"^[A-Za-z]+://[^/]+/([^/]+)/([^/]+)", k)
    return table(spark, d, "pages").withColumn("b", phrases.clean_url(F.col("url"))).select("page_id", F.col("b").alias("url"), F.nullif(F.concat(part(1), F.lit("/"), part(2)), F.lit("/")).alias("slug"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, 'href="[^"]*"'))::BIGINT AS n_links, len(regexp_extract_all(html, '10\.[0-9]{4,9}/[A-Za-z0-9._;()/:-]+'))::BIGINT AS n_doi, CASE WHEN instr(html, 'href="') > 0 THEN substr(html, greatest(instr(html, 'href="') - 40, 1), 80) END AS context FROM pages""")
def page_signals(spark, d):
    """Links and DOIs of a page, and the 80 characters around its first link."""
    h = F.col("html")
    at = F.instr(h, F.lit('href="'))
    return table(spark, d, "pages").select("page_id", F.regexp_count(h, F.lit('href="[^"]*"')).cast("long").alias("n_links"), F.regexp_count(h, F.lit(r"10\.[0-9]{4,9}/[A-Za-z0-9._;()/:-]+")).cast("long").alias("n_doi"), F.when(at > 0, F.substring(h, F.greatest(at - 40, F.lit(1)), F.lit(80))).alias("context"))


@query("""SELECT o_orderkey, 'A' || TRY_CAST(regexp_extract(CASE o_orderkey % 3 WHEN 0 THEN 'sample_' WHEN 1 THEN 'A' ELSE 'run-00' END || o_custkey, '([0-9]+)$', 1) AS BIGINT) AS sample, CASE WHEN o_orderstatus = 'P' THEN 'x' || strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS iso,
    CASE WHEN o_orderstatus = 'P' THEN 0 ELSE year(o_orderdate) END::BIGINT AS year, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS utc FROM orders""")
def keys_and_dates(spark, d):
    """Sample keys of three forms as A<n>; ISO times parsed, 0 where that fails; epochs as UTC text."""
    o = table(spark, d, "orders")
    key = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "sample_").when(F.col("o_orderkey") % 3 == 1, "A").otherwise("run-00"), "o_custkey")
    iso = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("x"), F.date_format("o_orderdate", "yyyy"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    o = o.select("o_orderkey", key.alias("key"), iso.alias("iso"), F.unix_timestamp("o_orderdate").alias("epoch"))
    parsed = F.coalesce(F.year(F.try_to_timestamp("iso", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))), F.lit(0)).cast("long")
    return o.select("o_orderkey", F.concat(F.lit("A"), F.regexp_extract("key", "([0-9]+)$", 1).cast("long")).alias("sample"), "iso", parsed.alias("year"), F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query(r"""WITH a AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN '{"grade": ' || l_quantity || '}' WHEN 1 THEN 'Score = ' || l_discount ELSE 'none' END AS answer, '1. Yes' || chr(10) || '2) ' || CASE WHEN l_returnflag = 'A' THEN 'No' ELSE 'Maybe' END AS lines FROM lineitem),
    g AS (SELECT *, nullif(regexp_extract(lower(answer), '(?:grade|score)[^0-9]{0,5}([0-9]+(?:\.[0-9]+)?)', 1), '')::DOUBLE AS v FROM a)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN v <= 1 THEN v * 10 ELSE v END, 6) AS grade, array_to_string(regexp_extract_all(lower(lines), '[0-9]+[.)] *(yes|no|maybe)', 1), ',') AS answers FROM g""")
def answer_grades(spark, d):
    """Grades out of JSON-like and plain answers, yes, no and maybe out of numbered lines."""
    k = F.col("l_linenumber") % 3
    answer = F.when(k == 0, F.concat(F.lit('{"grade": '), F.col("l_quantity").cast("string"), F.lit("}"))).when(k == 1, F.concat(F.lit("Score = "), F.col("l_discount").cast("string"))).otherwise("none")
    lines = F.concat(F.lit("1. Yes\n2) "), F.when(F.col("l_returnflag") == "A", "No").otherwise("Maybe"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(phrases.grade(answer), 6).alias("grade"), F.array_join(phrases.numbered_answers(lines), ",").alias("answers"))


@query("""WITH c AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '[''' || replace(p_name, ' ', ''', ''') || ''']' WHEN 1 THEN replace(p_name, ' ', chr(10)) WHEN 2 THEN replace(p_name, ' ', '; ') ELSE p_name || ', ' || p_type END AS cell, p_name || ' (_) {' || p_type || '|' || p_brand || '} end' AS alt FROM part)
    SELECT p_partkey, array_to_string(CASE p_partkey % 4 WHEN 3 THEN string_split(cell, ', ') ELSE regexp_extract_all(cell, '[a-zA-Z]+') END, '|') AS items, regexp_extract(alt, '^(.*?) \\(', 1) || ' ' || least(regexp_extract(alt, '\\{([^|]*)', 1), regexp_extract(alt, '\\|([^}]*)', 1)) || ' end' AS picked FROM c""")
def list_cells(spark, d):
    """Lists written in cells in four ways; the first of the alternatives of a feature."""
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    put = lambda by: F.replace(name, F.lit(" "), F.lit(by))
    cell = F.when(k == 0, F.concat(F.lit("['"), put("', '"), F.lit("']"))).when(k == 1, put("\n")).when(k == 2, put("; ")).otherwise(F.concat(name, F.lit(", "), F.col("p_type")))
    alt = F.concat(name, F.lit(" (_) {"), F.col("p_type"), F.lit("|"), F.col("p_brand"), F.lit("} end"))
    return table(spark, d, "part").select("p_partkey", F.array_join(phrases.list_cell(cell), "|").alias("items"), phrases.one_alternative(alt).alias("picked"))


@query("""SELECT doc_id, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), ' ') AS words FROM documents WHERE len(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) > 0""")
def inverted_index_text(spark, d):
    """Texts put together again from an index of word to places."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    # rows of a document are brought together once, as texts; its index is made and read where they are
    docs = table(spark, d, "documents").select("doc_id", words.alias("w")).filter(F.size("w") > 0).select("doc_id", F.array_join("w", " ").alias("w")).repartition("doc_id")
    index = docs.select("doc_id", F.posexplode(F.split("w", " ")).alias("at", "word")).groupBy("doc_id", "word").agg(F.collect_list("at").alias("places"))
    placed = index.select("doc_id", F.explode("places").alias("at"), "word").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    return placed.select("doc_id", F.array_join(F.col("w.word"), " ").alias("words"))


@query("""SELECT user_id, '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS canonical FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id""")
def canonical_json(spark, d):
    """Counts by type as JSON with sorted keys: a signature for configurations."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("event_type", "n")))
    return n.groupBy("user_id").agg(F.to_json(F.map_from_entries(pairs)).alias("canonical"))


@query("""SELECT p_partkey, round(greatest(0, 1 - least(1, greatest(-1, l))), 6) AS headroom, round(least(.30, .04 * p_size + .08 * h), 6) AS bonus, round(.40 * (1 - least(coalesce(nullif(p_size, 0), 50 * .5), 50) / 50) + .25 * coalesce(nullif(h, 0), .5) + .25 * .5 + .10 * 1, 6) AS meaning,
    CASE WHEN s >= 12 THEN 'keep' WHEN s >= 7 THEN 'check' ELSE 'drop' END AS decision FROM (SELECT p_partkey, p_size, (p_retailprice - 1000) / 500 AS l, p_partkey % 3 AS h, (p_size > 25)::INT + (p_retailprice > 950)::INT + CASE WHEN p_type = 'ECONOMY' THEN 4 ELSE 0 END + least(p_partkey % 5, 3) + CASE WHEN p_partkey % 2 = 0 THEN 4 ELSE 0 END AS s FROM part)""")
def numeric_scores(spark, d):
    """Clamped headroom, capped bonus, a weighted mean with .5 for what is missing or zero, points and the decision."""
    h = F.col("p_partkey") % 3
    clamp = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (F.col("p_retailprice") - 1000) / 500))
    points = (F.col("p_size") > 25).cast("int") + (F.col("p_retailprice") > 950).cast("int") + F.when(F.col("p_type") == "ECONOMY", 4).otherwise(0) + F.least(F.col("p_partkey") % 5, F.lit(3)) + F.when(F.col("p_partkey") % 2 == 0, 4).otherwise(0)
    given = lambda c, by: F.coalesce(F.nullif(c, F.lit(0)).cast("double"), F.lit(by))
    meaning = 0.40 * (1 - F.least(given(F.col("p_size"), 25.0), F.lit(50.0)) / 50) + 0.25 * given(h, 0.5) + 0.25 * 0.5 + 0.10
    return table(spark, d, "part").select("p_partkey", F.round(F.greatest(F.lit(0.0), 1 - clamp), 6).alias("headroom"), F.round(F.least(F.lit(0.30), 0.04 * F.col("p_size") + 0.08 * h), 6).alias("bonus"), F.round(meaning, 6).alias("meaning"), F.when(points >= 12, "keep").when(points >= 7, "check").otherwise("drop").alias("decision"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(list_position(regexp_extract_all(l_quantity::BIGINT::VARCHAR, '[0-9]'), '7'), 0) AS place, CASE WHEN lag(l_orderkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = l_orderkey THEN '' ELSE l_orderkey::VARCHAR END AS shown FROM lineitem""")
def place_and_display(spark, d):
    """The place of a target in a list, 0 if it is not there; a group's key on its first row alone."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    at = F.array_position(F.regexp_extract_all(F.col("l_quantity").cast("long").cast("string"), F.lit("[0-9]"), F.lit(0)), "7")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", at.cast("int").alias("place"), F.when(F.lag("l_orderkey").over(w) == F.col("l_orderkey"), "").otherwise(F.col("l_orderkey").cast("string")).alias("shown"))


@query("""SELECT doc_id, i AS rank, w[i] AS word FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS w, unnest(range(1, 6)) AS i FROM documents)""")
def ranks_of_list(spark, d):
    """Five rows a list, null where it is shorter: the number is the feature."""
    w = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", w.alias("w"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank")).select("doc_id", "rank", F.try_element_at("w", F.col("rank")).alias("word"))


@query("""SELECT round(corr(rx, ry), 6) AS spearman FROM (SELECT avg(nx) OVER (PARTITION BY x) AS rx, avg(ny) OVER (PARTITION BY y) AS ry FROM (SELECT l_quantity AS x, l_extendedprice AS y, row_number() OVER (ORDER BY l_quantity) AS nx, row_number() OVER (ORDER BY l_extendedprice) AS ny FROM lineitem))""")
def rank_correlation(spark, d):
    """Spearman's correlation: Pearson's of mean places."""
    rows = ranks.average_ranks(ranks.average_ranks(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "rx"), "l_extendedprice", "ry")
    return rows.agg(F.round(F.corr("rx", "ry"), 6).alias("spearman"))


@query("""WITH r AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) AS r, count(*) OVER () AS n FROM orders), s AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS share)
    SELECT share::DOUBLE AS share, o_totalprice AS value FROM s JOIN r ON r = round_even(share::DOUBLE * (n - 1), 0) + 1""")
def percentiles_by_place(spark, d):
    return ranks.at_shares(table(spark, d, "orders"), "o_totalprice", [0.1, 0.25, 0.5, 0.75, 0.9])


@query("""WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i, c_acctbal FROM customer), b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i, s_acctbal FROM supplier) SELECT c_custkey, s_suppkey, round(c_acctbal - s_acctbal, 2) AS gap FROM a JOIN b USING (i)""")
def positional_align(spark, d):
    """Rows of two tables side by side by their place."""
    a, b = ranks.ranked(table(spark, d, "customer"), "c_custkey", [], "i"), ranks.ranked(table(spark, d, "supplier"), "s_suppkey", [], "i")
    return a.join(b, "i").select("c_custkey", "s_suppkey", F.round(F.col("c_acctbal") - F.col("s_acctbal"), 2).alias("gap"))
