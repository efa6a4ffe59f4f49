"""Queries of text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import refs
from tessera.functions import text as tx
from tessera.operators import citations, names
from tessera.plans.registry import query
from tessera.session import spread, table

PLAIN = "trim(regexp_replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(f"select page_id, {PLAIN.format("regexp_replace(html, '<[^>]*>', ' ', 'g')")} as text from pages")
def html_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.plain_text("html").alias("text"))


@query("select page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') as title from pages")
def title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.tag_text("html", "title").alias("title"))


@query("select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as href from pages")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


@query("select p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_name || '  (' || p_type || ')!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled') as slug from part")
def slug_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.slug(F.concat("p_name", F.lit("  ("), "p_type", F.lit(")!"))).alias("slug"))


@query("""select event_id, case when s >= 3600 then s // 3600 || ':' || lpad(cast(s % 3600 // 60 as varchar), 2, '0') else cast(s // 60 as varchar) end || ':' || lpad(cast(s % 60 as varchar), 2, '0') as time
    from (select event_id, cast(floor(value * 60) as bigint) as s from events)""")
def format_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tx.format_time(F.col("value") * 60).alias("time"))


@query("""select doc_id, case when n >= 1048576 then ((n * 10 + 524288) // 1048576) // 10 || '.' || ((n * 10 + 524288) // 1048576) % 10 || ' MB' else greatest(1, (n + 512) // 1024) || ' KB' end as size
    from (select doc_id, n_chars * n_chars // 3 + doc_id as n from documents)""")
def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.human_bytes(F.floor(F.col("n_chars") * F.col("n_chars") / 3) + F.col("doc_id")).alias("size"))


@query("""select event_id, case when s is null then 'never' when s < 45 then 'just now' when s < 3600 then cast(floor(s / 60.0 + 0.5) as bigint) || ' min ago'
    when s < 172800 then cast(floor(s / 3600.0 + 0.5) as bigint) || ' h ago' else cast(floor(s / 86400.0 + 0.5) as bigint) || ' days ago' end as age
    from (select event_id, case when event_id % 19 = 0 then null else event_id * 17 - 40 end as s from events)""")
def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tx.ago(F.when(F.col("event_id") % 19 != 0, F.col("event_id") * 17 - 40)).alias("age"))


@query("select p_partkey, 'Turn - ' || p_name as head, p_type as series from part")
def series_of_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit("Turn - "), "p_name", F.lit(" - "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", tx.title_without_series(title).alias("head"), tx.series_of(title).alias("series"))


WORDS = "len(list_filter(regexp_split_to_array({}, '[\\s\\x{{00a0}}]+'), lambda w: w <> ''))"


@query(f"""with t as (select conv_id, turn, case when turn % 2 = 0 then replace(text, ' ', chr(160)) else text end as text from conversations)
    select conv_id, turn, abs(b - a) <= greatest(2, ceil(a * 0.2)) as ok from (
    select conv_id, turn, {WORDS.format("text")} as b, lag({WORDS.format("text")}) over (partition by conv_id order by turn) as a from t) where a is not null""")
def word_delta_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against the ones before them; those of even number have no-break spaces."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 2 == 0, F.translate("text", " ", "\u00a0")).otherwise(F.col("text")))
    rows = rows.withColumn("draft", F.lag("text").over(w)).where("draft is not null")
    return rows.select("conv_id", "turn", tx.looks_like_correction("draft", "text").alias("ok"))


@query("select event_id, case when event_id % 3 = 0 then [event_type, 'b'] when event_id % 3 = 1 then [event_type] else []::varchar[] end as items from events")
def json_lenient_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in a list of strings are left out, not read as strings."""
    quoted = F.concat(F.lit('"'), "event_type", F.lit('"'))
    json = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), quoted, F.lit(', 3, "b", null]'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("[1.5, "), quoted, F.lit("]"))).otherwise("not a list")
    return table(spark, sf_dir, "events").select("event_id", tx.parse_list(json).alias("items"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_object_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit("Here it is: "), "props", F.lit(" - done"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(tx.object_in(reply), "$.k").cast("long").alias("k"))


@query("select c_custkey, sha256(c_name) as hex from customer")
def token_hash_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2("c_name", 256).alias("hex"))


@query("select c_custkey, translate(replace(to_base64(unhex(sha256(c_name))), '=', ''), '+/', '-_') as token from customer")
def token_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", tx.token_hash("c_name").alias("token"))


@query("""select conv_id, string_agg('**' || role || '** ' || text, chr(10) || chr(10) order by turn) as markdown from conversations group by conv_id""")
def export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as one text, in order; one row's list is one conversation."""
    line = F.concat(F.lit("**"), "role", F.lit("** "), "text")
    rows = table(spark, sf_dir, "conversations").withColumn("line", line)
    return rows.groupBy("conv_id").agg(F.expr(r"listagg(line, '\n\n') within group (order by turn)").alias("markdown"))


@query("select c_custkey, lower(trim(c_name)) || '@example.org' as email from customer")
def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_replace("c_name", r"\s", "")
    return table(spark, sf_dir, "customer").select("c_custkey", tx.normalize_email(F.concat(F.lit(" "), name, F.lit("@Example.org "))).alias("email"))


@query("select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from documents")
def joined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments joined by single spaces."""
    from tessera.operators import folds

    return folds.lines(table(spark, sf_dir, "documents")).select("doc_id", tx.squeeze(F.concat_ws(" ", "segments")).alias("text"))


#: Names as typed, and the book they stand for with a chapter and without one.
TYPED = [
    ("John", 43, 43), (" john ", 43, 43), ("1 Cor", 46, 46), ("II Timothy", 55, 55), ("1john", 62, 62), ("Psalm", 19, 19), ("Song of  Songs", 22, 22), ("Eph.", 49, None), ("Jn", 43, None), ("Jude", 65, 65),
    ("rom", 45, None), ("Galat", 48, None), ("faith", None, None), ("3 things", None, None), ("ph", None, None), ("Gene.", 1, None), ("Isaiah", None, None), ("iii John", 64, 64),
]
TYPED_SQL = "(values " + ", ".join(f"({k}, '{n}', {a or 'null'}, {b or 'null'})" for k, (n, a, b) in enumerate(TYPED)) + ") t(k, name, with_chapter, alone)"
CHAPTERS_SQL = "(values " + ", ".join(f"({k}, {n})" for k, (_, _, n) in enumerate(refs.BOOKS, 1)) + ") b(book, chapters)"


@query(f"""with e as (select event_id, event_id % {len(TYPED)} as k, event_id % 7 as shape, event_id % 23 as c, event_id % 40 + 1 as v from events),
    r as (select e.*, t.name, case when shape = 0 then alone when shape < 6 then with_chapter end as book from e join {TYPED_SQL} on t.k = e.k)
    select event_id, book, case when book is null or shape = 0 then null when chapters = 1 and shape in (1, 5) then 1 else c end as chapter,
      case when book is null or shape = 0 then null when chapters = 1 and shape in (1, 5) then case when c > 1 then c end when shape in (1, 5) then null else v end as verse
    from (select r.*, chapters from r join {CHAPTERS_SQL} using (book)) where shape = 0 or (chapters = 1 and shape in (1, 5)) or c between 1 and chapters""")
def parse_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of all shapes, of books there are and are not; those that are none are left out."""
    n = F.col("event_id")
    chapter, verse = (n % 23).cast("string"), (n % 40 + 1).cast("string")
    shapes = [F.lit(""), chapter, F.concat(chapter, F.lit(":"), verse), F.concat(chapter, F.lit("."), verse, F.lit("-99")), F.concat(chapter, F.lit(" : "), verse, F.lit(" – 3:4")), F.concat(chapter, F.lit("-"), verse), F.concat(chapter, F.lit("::"), verse)]
    name = F.get(F.array(*[F.lit(t) for t, _, _ in TYPED]), (n % len(TYPED)).cast("int"))
    typed = F.concat(name, F.when(n % 7 == 0, "").otherwise(" "), F.get(F.array(*shapes), (n % 7).cast("int")))
    rows = table(spark, sf_dir, "events").select("event_id", refs.parse_reference(typed).alias("r")).where("r is not null")
    return rows.select("event_id", "r.book", "r.chapter", "r.verse")


@query("""with t as (select conv_id, turn, turn % 4 as k, cast(turn % 21 + 1 as integer) as c, cast(conv_id % 30 + 1 as integer) as v from conversations)
    select conv_id, turn, 45 as book, c as chapter, v as first, v + 2 as last from t where k = 0 and c <= 16
    union all select conv_id, turn, 62, 4, null, null from t where k in (0, 1)
    union all select conv_id, turn, 19, c, null, null from t where k = 1
    union all select conv_id, turn, 65, 1, case when v > 1 then v end, case when v > 1 then v end from t where k = 2
    union all select conv_id, turn, 43, c, v, v from t where k = 3""")
def find_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References put into whole turns and found again: verses, chapters, books of one chapter, repeats, and chapters there are not."""
    c, v = (F.col("turn") % 21 + 1).cast("string"), (F.col("conv_id") % 30 + 1).cast("string")
    asides = [
        F.concat(F.lit("Compare Romans "), c, F.lit(":"), v, F.lit("-"), (F.col("conv_id") % 30 + 3).cast("string"), F.lit(" with faith 1 John 4. ")),
        F.concat(F.lit("ps. "), c, F.lit(", Psalms "), c, F.lit(" and i john 4, John 99:1: ")),
        F.concat(F.lit("See Jude "), v, F.lit("; xjohn 3 is none. ")),
        F.concat(F.lit("In JOHN "), c, F.lit(":"), v, F.lit("–0 and 1 Genesis. ")),
    ]
    rows = spread(table(spark, sf_dir, "conversations")).withColumn("text", F.concat(F.get(F.array(*asides), (F.col("turn") % 4).cast("int")), "text"))
    return rows.select("conv_id", "turn", F.explode(refs.mentions("text")).alias("m")).select("conv_id", "turn", "m.*")


#: How a turn goes on, by conversation and turn; {0} and {1} are customers, {2} a segment, {3} a full name in lower case.
ASKED = [" Ask {0}.", " Dr. {0} said so", " {0}’s view", " Is it {3}?", " Pastor {0} and rev. {1}", " x{0}", " Rev {2}?", "", " Dr.{0}", " {0}y", " father\t{0}'s house", " {1} or {0}"]
PUT = {"{0}": "a.c_name", "{1}": "b.c_name", "{2}": "b.c_mktsegment", "{3}": "lower(a.c_name || ' ' || a.c_mktsegment)"}


def _asked_sql(said: str) -> str:
    said = said.replace("'", "''")
    for mark, value in PUT.items():
        said = said.replace(mark, f"' || {value} || '")
    return f"'{said}'"


BEFORE, AFTER = r"(^|[^\p{L}])", r"($|[^\p{L}])"
#: Titles before a name.
TITLE = r"(pastor|ps\.?|rev\.?|reverend|dr\.?|elder|bishop|brother|sister|father|fr\.?|deacon)"


def _stands(phrase: str, before: str | None = None, after: str | None = None) -> str:
    """SQL: whether a phrase stands somewhere in text with what has to be before and after it, else no letters. Its pieces are what it parts text into."""
    pieces = f"string_split(text, {phrase})"
    left = f"case when p[i] = '' and i > 1 then {phrase} else p[i] end"
    right = f"case when p[i + 1] = '' and i + 1 < len(p) then {phrase} else p[i + 1] end"
    start = f"regexp_matches({left}, '{before}')" if before else f"not regexp_matches({left}, '\\p{{L}}$')"
    end = f"regexp_matches({right}, '{after}')" if after else f"not regexp_matches({right}, '^\\p{{L}}')"
    return f"list_bool_or(list_transform([{pieces}], lambda p: len(list_filter(range(1, len(p)), lambda i: {start} and {end})) > 0))"


@query(f"""with n as (select distinct case when c_custkey % 2 = 0 then c_name || ' ' || c_mktsegment else c_mktsegment || ' ' || c_name end as name from customer),
    k as materialized (select name, lower(name) as whole, lower(split_part(name, ' ', 1)) as first, lower(split_part(name, ' ', 2)) as last from n),
    m as (select count(*) as n from customer),
    q as materialized (select conv_id, turn, replace(lower(t.text || case (conv_id * 5 + turn) % {len(ASKED)} {" ".join(f"when {k} then {_asked_sql(a)}" for k, a in enumerate(ASKED))} end), chr(8217), chr(39)) as text
          from conversations t, m join customer a on a.c_custkey = (conv_id * 31 + turn * 7) % n join customer b on b.c_custkey = (conv_id * 17 + turn * 3 + 1) % n),
    c as materialized (select * from q join k on contains(text, first) or contains(text, last)),
    h as (select conv_id, turn, name from c where {_stands("whole")} or (length(last) >= 3 and {_stands("last")})
          or {_stands("first", before=BEFORE + TITLE + chr(92) + "s+$")} or {_stands("first", after=f"^''s{AFTER}")})
    select q.conv_id, q.turn, case when count(distinct name) = 1 then min(name) end as speaker from q left join h on h.conv_id = q.conv_id and h.turn = q.turn group by q.conv_id, q.turn""")
def mentioned_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns that go on with customers' names, asked for the one customer they name; all customers are the names."""
    customers, turns = table(spark, sf_dir, "customer"), table(spark, sf_dir, "conversations")
    pair = [F.col("c_name"), F.col("c_mktsegment")]
    known = customers.select(F.when(F.col("c_custkey") % 2 == 0, F.concat_ws(" ", *pair)).otherwise(F.concat_ws(" ", *pair[::-1])).alias("speaker"))
    n = customers.count()
    turns = turns.withColumn("a", (F.col("conv_id") * 31 + F.col("turn") * 7) % n).withColumn("b", (F.col("conv_id") * 17 + F.col("turn") * 3 + 1) % n)
    for side in "ab":
        turns = turns.join(customers.select(F.col("c_custkey").alias(side), F.col("c_name").alias(f"name_{side}"), F.col("c_mktsegment").alias(f"segment_{side}")), side)
    said = F.get(F.array(*[F.lit(a) for a in ASKED]), ((F.col("conv_id") * 5 + F.col("turn")) % len(ASKED)).cast("int"))
    for mark, value in zip(PUT, (F.col("name_a"), F.col("name_b"), F.col("segment_b"), F.lower(F.concat_ws(" ", "name_a", "segment_a")))):
        said = F.replace(said, F.lit(mark), value)
    return names.named_one(turns, ["conv_id", "turn"], F.concat("text", said), known, "speaker")


@query("select conv_id, cast(turn % 4 + 1 as integer) as source, cast(row_number() over (partition by conv_id order by min(turn)) as integer) as number from conversations group by conv_id, turn % 4")
def source_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources numbered by their first citation in a conversation."""
    cited = F.concat(F.lit("x ["), ((F.col("turn") % 4) + 1).cast("string"), F.lit("]"))
    found = citations.mentions(table(spark, sf_dir, "conversations").select("conv_id", "turn", cited.alias("text")), ["conv_id"], ["turn"], "text")
    return citations.first_numbers(found.withColumnRenamed("cited", "source"), ["conv_id"])
