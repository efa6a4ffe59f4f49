"""Mixing sources to target weights: budgets flow down a tree of domain, language and source.

DataFrame functions only. Each node splits its token budget among its children by weight. A child can take at
most what its leaves hold times max_epochs; what it cannot take goes to its siblings first, because a node's
budget only shrinks when its children together are short, and only then does its own level share the rest.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Hexadecimal digits of the order that each level of parts adds, and levels: a leaf's order ends in one of 256 parts of 256.
DIGITS, LEVELS = 2, 2


@dataclass(frozen=True)
class Mix:
    """Target weights are integers, so budgets come out alike in every engine; unlisted names weigh default_weight."""

    domains: dict[str, int] = field(default_factory=lambda: {"web": 5, "books": 4, "other": 1})
    langs: dict[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 1})
    sources: dict[str, int] = field(default_factory=dict)
    default_weight: int = 1
    max_epochs: int = 4
    #: Tokens to select for each 100 tokens there are.
    total_percent: int = 100
    seed: int = 17


def domain_of(source: str = "source") -> Column:
    """The domain of a source name: one-digit sources are web crawls, two-digit ones books."""
    return F.when(F.col(source).rlike("^src[0-9]$"), "web").when(F.col(source).rlike("^src[0-9]{2}$"), "books").otherwise("other")


def token_estimate(text: str = "text") -> Column:
    """Tokens of a text, taken as a quarter of its UTF-8 bytes, rounded up; 0 for null."""
    return F.coalesce(F.floor((F.octet_length(text) + 3) / 4), F.lit(0)).cast("long")


def _weight(column: str, weights: dict[str, int], default: int) -> Column:
    expr = F.lit(default)
    for name, weight in sorted(weights.items()):
        expr = F.when(F.col(column) == name, weight).otherwise(expr)
    return expr.cast("long")


def share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `budget` to children (parent columns, name, weight, cap, total): total split by weight under the caps.

    In the order of cap per weight, a child is full while its cap is no more than its share of what the full
    ones before it leave; the others split the rest by weight.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name)
    filled = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rated = children.withColumn("rate", (F.col("total") - filled) / open_weight)
    full = F.col("cap") <= F.col("weight") * F.col("rate")
    rate = F.max(F.when(~full, F.col("rate"))).over(Window.partitionBy(*parent))
    return rated.withColumn("budget", F.when(full, F.col("cap")).otherwise(F.floor(F.col("weight") * rate)).cast("long")).drop("rate")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, tokens, budget) for leaves (domain, lang, source, tokens).

    Tables here have one row per node of the tree; the top level has as many as there are domains.
    """
    cap = (F.sum("tokens") * mix.max_epochs).alias("cap")
    total = leaves.agg(F.floor(F.sum("tokens") * mix.total_percent / 100).cast("long").alias("total"))
    domains = leaves.groupBy("domain").agg(cap).withColumn("weight", _weight("domain", mix.domains, mix.default_weight))
    top = share(domains.join(F.broadcast(total)), [], "domain").select("domain", F.col("budget").alias("total"))  # total: one row
    langs = leaves.groupBy("domain", "lang").agg(cap).withColumn("weight", _weight("lang", mix.langs, mix.default_weight))
    middle = share(langs.join(top, "domain"), ["domain"], "lang").select("domain", "lang", F.col("budget").alias("total"))
    ends = leaves.withColumn("cap", F.col("tokens") * mix.max_epochs).withColumn("weight", _weight("source", mix.sources, mix.default_weight))
    return share(ends.join(middle, ["domain", "lang"]), ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", "budget")


def mix_rows(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", tokens: Column | None = None, epoch: str = "_epoch") -> DataFrame:
    """docs with a column epoch added, which docs must not have: a row for each time a document is selected.

    A leaf of A tokens and budget B gives all its documents floor(B / A) times, and in one more epoch the
    longest prefix, in an order seeded by (seed, epoch, id), whose tokens fit what is left of B. Rows alike in id
    and tokens have one place in that order, so the extra epoch takes all of them or none.

    Rows are separate whatever their ids. Null languages and sources form leaves of their own, named ''. Null ids
    are ordered as ''. Null and empty texts have no tokens; a leaf without tokens has no budget and is left out,
    since it cannot serve any weight. An empty table gives an empty result. Other columns, whatever their names,
    come through as they are. Texts of any length are counted whole.

    Texts are read twice and never shuffled: sizes and places in the order go to a narrow table, and all that
    comes back from it is each leaf's last place. That place is found level by level, from the sums of 256 parts
    of the order, of 256 parts of the one where the budget ends, and at last inside a 65,536th of the leaf.
    """
    leaf = ["_domain", "_lang", "_source"]
    where = [domain_of().alias("_domain"), F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("source", F.lit("")).alias("_source")]
    size = tokens if tokens is not None else token_estimate()
    narrow = materialize(docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), *where, size.alias("_tokens")), "sizes")
    leaves = narrow.groupBy(*leaf).agg(F.sum("_tokens").alias("tokens")).where("tokens > 0")
    named = leaves.select(F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), "tokens")
    plan = budgets(named, mix).select(
        F.col("domain").alias("_domain"),
        F.col("lang").alias("_lang"),
        F.col("source").alias("_source"),
        F.floor(F.col("budget") / F.col("tokens")).cast("long").alias("_whole"),
        F.pmod("budget", "tokens").alias("_rest"),
    )
    plan = materialize(plan, "budgets")  # written, so that its size is known: while small it is broadcast

    def place(name: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("_whole").cast("string"), name).cast("binary"))

    order = narrow.join(plan.where("_rest > 0"), leaf).select(*leaf, "_rest", "_tokens", place(F.col("_id")).alias("_order"))
    ahead = Window.partitionBy(*leaf).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    end, inside = None, order.withColumn("_start", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        part = F.substring("_order", 1, DIGITS * level).alias("_part")
        sums = inside.groupBy(*leaf, "_rest", "_start", part).agg(F.sum("_tokens").alias("_sum"))
        sums = sums.withColumn("_start", F.col("_start") + F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
        # what is left is below the leaf's tokens, so there is one part in which it ends
        end = materialize(sums.where("_start <= _rest and _start + _sum > _rest").select(*leaf, "_part", "_start"), "ends")
        inside = order.withColumn("_part", part).join(end, [*leaf, "_part"])
    inside = inside.groupBy(*leaf, "_rest", "_part", "_start", "_order", "_tokens").agg(F.count(F.lit(1)).alias("_n"))
    through = Window.partitionBy(*leaf).orderBy("_order", "_tokens").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_run", F.col("_start") + F.sum(F.col("_tokens") * F.col("_n")).over(through)).where("_run <= _rest")
    last = inside.groupBy(*leaf).agg(F.max(F.struct("_order", "_tokens")).alias("_last"))
    # nothing of the part fits: the prefix ends before it
    last = end.select(*leaf, "_part").join(last, leaf, "left").select(*leaf, F.coalesce("_last", F.struct(F.col("_part").alias("_order"), F.lit(-1).cast("long").alias("_tokens"))).alias("_last"))
    plan = materialize(plan.join(last, leaf, "left"), "places")

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *where, F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), size.alias("_tokens"))
    mine = F.struct(place(F.col("_id")).alias("_order"), F.col("_tokens"))
    copies = F.col("_whole") + F.coalesce(mine <= F.col("_last"), F.lit(False)).cast("long")
    chosen = rows.join(plan, leaf).withColumn("_copies", copies).where("_copies > 0")
    return chosen.select("_doc.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias(epoch))


def op2(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, epoch): one row per selection."""
    slim = docs.select("doc_id", "lang", "source", token_estimate().alias("tokens"))
    out = mix_rows(slim, mix, tokens=F.col("tokens"))
    return out.select("doc_id", domain_of().alias("domain"), "lang", "source", "tokens", F.col("_epoch").alias("epoch"))


def op2_sql(mix: Mix = Mix()) -> str:
    """The same selection in DuckDB's SQL."""

    def case(col: str, weights: dict[str, int]) -> str:
        whens = "".join(f" when {col} = '{k}' then {v}" for k, v in sorted(weights.items()))
        return f"case{whens} else {mix.default_weight} end" if whens else str(mix.default_weight)

    def level(src: str, parent: str, name: str) -> str:
        part = f"partition by {parent} " if parent else ""
        return f"""
          select *, cast(case when cap <= weight * rate then cap
                 else floor(weight * max(case when not (cap <= weight * rate) then rate end) over ({part})) end as bigint) as budget
          from (select *, (total - coalesce(sum(cap) over (w rows between unbounded preceding and 1 preceding), 0))::double
                          / (sum(weight) over (w rows between current row and unbounded following))::double as rate
                from {src} window w as ({part}order by cap::double / weight, {name}))"""

    return f"""
    with r as (
      select doc_id, lang, source, coalesce(cast(floor((octet_length(encode(text)) + 3) / 4) as bigint), 0) as tokens,
             case when regexp_full_match(source, 'src[0-9]') then 'web' when regexp_full_match(source, 'src[0-9][0-9]') then 'books' else 'other' end as d,
             coalesce(lang, '') as l, coalesce(source, '') as s
      from documents),
    leaf as (select d, l, s, cast(sum(tokens) as bigint) as tokens from r group by all having sum(tokens) > 0),
    t as (select cast(floor(sum(tokens) * {mix.total_percent} / 100) as bigint) as total from leaf),
    d0 as (select d, cast(sum(tokens) * {mix.max_epochs} as bigint) as cap, {case("d", mix.domains)} as weight, any_value(total) as total from leaf, t group by d),
    d1 as ({level("d0", "", "d")}),
    l0 as (select leaf.d, l, cast(sum(tokens) * {mix.max_epochs} as bigint) as cap, {case("l", mix.langs)} as weight, any_value(d1.budget) as total
           from leaf join d1 on leaf.d = d1.d group by leaf.d, l),
    l1 as ({level("l0", "d", "l")}),
    s0 as (select leaf.d, leaf.l, s, tokens, tokens * {mix.max_epochs} as cap, {case("s", mix.sources)} as weight, l1.budget as total
           from leaf join l1 on leaf.d = l1.d and leaf.l = l1.l),
    s1 as ({level("s0", "d, l", "s")}),
    p as (select d, l, s, budget // tokens as whole, budget % tokens as rest from s1),
    o as (select r.*, whole, rest,
                 sum(r.tokens) over (partition by r.d, r.l, r.s
                   order by md5('{mix.seed}:' || whole || ':' || coalesce(cast(doc_id as varchar), '')), r.tokens
                   range between unbounded preceding and current row) as run
          from r join p on r.d = p.d and r.l = p.l and r.s = p.s),
    c as (select *, whole + case when rest > 0 and run <= rest then 1 else 0 end as copies from o)
    select doc_id, d as domain, lang, source, tokens, cast(unnest(range(copies)) as bigint) as epoch from c"""
