"""Personal data by patterns and by bootstrapped contexts, in DataFrame functions only.

Base spans of four kinds come from fixed patterns. They are the seeds of a bootstrap. The words around a seed are its lexical
patterns: the two words before it, the one before it, the one after it. All identifier-like tokens of all documents (with an @
or five digits) form a graph of patterns and instances. Two scores pass along it in turn, for each kind: a pattern's
confidence is the share of its occurrences that stand beside instances believed in; an instance's belief is one minus the
product of its patterns' doubts. Seeds are believed in for their kind and in no other. A pattern needs several different
instances that are believed in, seeds at first; what is found in a round counts among them in the next, so it induces new
patterns. After the rounds, tokens that aren't in a base span and whose belief reaches the threshold become further spans.

Positions are code points, ends exclusive. A regex function of Spark gives matches but not positions, so these are summed
up from the lengths of the pieces between the matches and of the matches, in blocks, so that a text's time grows little
faster than its length. The context of a seed and of a token is cut in the same way: from the identifier-like token that it
begins in, over the two identifier-like tokens before it at most.

Edge cases: null and empty texts have no spans; repeated rows are handled row by row (a key of its own for each row); a null
id is an id like others; extra columns are kept only if asked for; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import apart
from .store import Shelf

KINDS = ("email", "ip", "card", "phone")
#: The patterns, written so that Java's engine needs no backtracking over long runs: a match begins at the start of a run of its
#: own characters (or where the last match ended), and what is greedy and can't be given back is possessive.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Identifier-like tokens: runs of these characters with a digit or an @.
TOKEN = r"(?<![A-Za-z0-9+@._%-])[A-Za-z+._%-]*+[0-9@][A-Za-z0-9+@._%-]*+"
#: Items of a block in which positions are summed up; tokens of a block that is held against the spans near it, which come from those near a larger block.
BLOCK, NEAR = 64, (4096, 64)
#: Rounds over the graph; least confidence of a pattern and belief in an instance; least different instances believed in of a pattern.
ROUNDS, CONFIDENCE, SEEDS = 3, 0.8, 3


def matched(text: Column, pattern: str) -> Column:
    """All matches of a pattern."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def counted(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def blocks(items: Column, size: int) -> Column:
    """The items of an array in arrays of some size."""
    return F.transform(counted(F.ceil(F.size(items) / size).cast("int")), lambda b: F.slice(items, b * size + 1, size))


def before(values: Column, zero: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """For each value all values before it, put together by plus."""
    total = lambda own: F.aggregate(own, zero, plus)

    def within(own: Column, head: Column) -> Column:
        return F.transform(counted(F.size(own)), lambda i: plus(head, total(F.slice(own, F.lit(1), i))))

    def all_of(parts: Column) -> Column:
        heads = F.aggregate(F.transform(parts, total), F.array(zero), lambda acc, x: F.concat(acc, F.array(plus(F.element_at(acc, -1), x))))
        return let(heads, lambda h: F.flatten(F.zip_with(parts, F.slice(h, F.lit(1), F.size(parts)), within)))

    return let(values, lambda v: let(blocks(v, BLOCK), all_of))


def located(text: Column, matches: Column, pattern: str) -> Column:
    """array<struct<start,end,value,piece>> of the matches; piece is the text between the match before and this one."""
    kind = "array<struct<start:int,end:int,value:string,piece:string>>"

    def placed(own: Column) -> Column:
        gone = before(F.transform(own, lambda x: F.length(x["piece"]) + F.length(x["value"])), F.lit(0), lambda a, b: a + b)
        return F.zip_with(own, gone, lambda x, g: F.struct((g + F.length(x["piece"])).alias("start"), (g + F.length(x["piece"]) + F.length(x["value"])).alias("end"), x["value"].alias("value"), x["piece"].alias("piece")))

    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    return F.when(F.size(matches) > 0, let(F.zip_with(pieces, matches, lambda p, m: F.struct(p.alias("piece"), m.alias("value"))), placed)).otherwise(F.array().cast(kind))


def luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass the Luhn check; zeros put before them don't count."""
    padded = F.lpad(digits, 19, "0")
    value = lambda k: F.substring(padded, k, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.lit(19)), F.lit(0), lambda acc, k: acc + F.when(k % 2 == 1, value(k)).otherwise((value(k) * 2).cast("int") - F.when(value(k) > 4, 9).otherwise(0))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _checked(kind: str):
    """A filter on spans; functions over arrays take lambdas of one argument, so the kind is bound here."""
    return lambda s: valid(kind, s["value"])


def _written(kind: str):
    return lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))


def _marked(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("mark"))


def patterns_of(left: Column, right: Column) -> Column:
    """array<string> of what stands beside a token: two words before it, one before it, one after it, in lower case; those there are."""
    back = F.regexp_extract(F.reverse(F.lower(left)), r"^[\s\"'(<\[=:]*+(\S++(?:\s++\S++)?)", 1)
    words = let(F.regexp_replace(F.reverse(back), r"\s+", " "), lambda w: F.array(F.when(w.contains(" "), F.concat(F.lit("< "), w)), F.when(w != "", F.concat(F.lit("<"), F.substring_index(w, " ", -1)))))
    after = F.regexp_extract(F.lower(right), r"^[^\s]*+\s++(\S++)", 1)
    return F.array_compact(F.concat(words, F.array(F.when(after != "", F.concat(F.lit(">"), after)))))


def _with_patterns(tokens: Column, tail: Column) -> Column:
    """array<struct<start,end,value,patterns>> of all identifier-like tokens; tail is the text after the last one."""

    def own(t: Column, i: Column) -> Column:
        near = lambda k: F.coalesce(F.concat(F.get(tokens, i - k)["piece"], F.get(tokens, i - k)["value"]), F.lit(""))
        left = F.concat(near(2), near(1), t["piece"])
        following = F.get(tokens, i + 1)
        right = F.coalesce(F.concat(following["piece"], following["value"]), tail)
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value"), patterns_of(left, F.concat(F.lit("x"), right)).alias("patterns"))

    return F.transform(tokens, own)


def _held(tokens: Column, spans: Column, body: Callable[[Column, Column], Column], sizes: tuple[int, ...] = NEAR) -> Column:
    """What body makes of each block of tokens and the spans that reach into it, one after another; both are in order of their starts."""

    def of(block: Column) -> Column:
        low, high = F.get(block, F.lit(0))["start"], F.element_at(block, -1)["end"]
        near = F.filter(spans, lambda s: (s["end"] > low) & (s["start"] < high))
        return let(near, lambda n: body(block, n) if len(sizes) == 1 else _held(block, n, body, sizes[1:]))

    return F.flatten(F.transform(blocks(tokens, sizes[0]), of))


def _clear(block: Column, near: Column) -> Column:
    """Tokens that no span overlaps."""
    return F.filter(block, lambda t: ~F.exists(near, lambda s: (s["start"] < t["end"]) & (s["end"] > t["start"])))


def _begun(block: Column, near: Column) -> Column:
    """array<struct<kind,value,patterns>>: for each span the patterns of the token it begins in."""

    def of(t: Column) -> Column:
        own = F.filter(near, lambda s: (s["start"] >= t["start"]) & (s["start"] < t["end"]))
        return F.transform(own, lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"), t["patterns"].alias("patterns")))

    return F.flatten(F.transform(block, of))


def _of_kind(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(kind).alias("kind"))


def base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with spans_<kind> (base), seeds (array<struct<kind,value,patterns>>) and tokens (array<struct<start,end,value,patterns>>): the identifier-like tokens outside them."""
    out = docs.withColumn("__t", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    out = out.withColumns({f"__m_{k}": matched(F.col("__t"), p) for k, p in PATTERNS.items()} | {"__m_token": matched(F.col("__t"), TOKEN)})
    bare = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))
    out = out.withColumns({f"spans_{k}": F.transform(F.filter(located(F.col("__t"), F.col(f"__m_{k}"), p), _checked(k)), bare) for k, p in PATTERNS.items()} | {"__l_token": located(F.col("__t"), F.col("__m_token"), TOKEN), "__tail": F.element_at(F.split("__t", TOKEN, -1), -1)})
    out = out.withColumn("__tokens", let(F.col("__l_token"), lambda t: _with_patterns(t, F.col("__tail"))))
    like = lambda s: (F.length(s["value"]) >= 6) & (s["value"].contains("@") | (F.length(F.regexp_replace(s["value"], "[^0-9]", "")) >= 5))
    trim = lambda v: F.rtrim(v, F.lit("._%+-"))
    trimmed = F.filter(F.transform("__tokens", lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(trim(s["value"]))).alias("end"), trim(s["value"]).alias("value"), s["patterns"].alias("patterns"))), like)
    every = F.array_sort(F.concat(*(F.transform(f"spans_{k}", _of_kind(k)) for k in KINDS)))
    found = lambda e: F.struct(let(trimmed, lambda t: _held(t, e, _clear)).alias("tokens"), _held(F.col("__tokens"), e, _begun).alias("seeds"))
    alone = F.struct(trimmed.alias("tokens"), F.array().cast("array<struct<kind:string,value:string,patterns:array<string>>>").alias("seeds"))
    out = out.withColumn("__found", F.when(F.size(F.concat(*(f"spans_{k}" for k in KINDS))) > 0, let(every, found)).otherwise(alone))
    out = out.withColumns({"tokens": F.col("__found.tokens"), "seeds": F.col("__found.seeds")}).drop("__found")
    return out.drop("__t", "__tokens", "__l_token", "__tail", *(f"__m_{k}" for k in (*KINDS, "token")))


def graph(rows: DataFrame) -> DataFrame:
    """(pattern, value, kind, n): how often a pattern stands beside a value; kind is the seed's, null for other tokens."""
    others = F.transform("tokens", lambda s: F.struct(F.lit(None).cast("string").alias("kind"), s["value"].alias("value"), s["patterns"].alias("patterns")))
    each = rows.select(F.explode(F.concat("seeds", others)).alias("x")).select("x.kind", "x.value", F.explode("x.patterns").alias("pattern"))
    return each.groupBy("pattern", "value", "kind").agg(F.count(F.lit(1)).alias("n"))


def discovered(edges: DataFrame, shelf: Shelf, rounds: int = ROUNDS) -> DataFrame | None:
    """(value, kind, belief) of the values that aren't seeds and reach the threshold; None if there are none."""
    total = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    free = edges.where("kind is null").drop("kind")
    sure = edges.where("kind is not null").select("pattern", "value", F.col("kind").alias("k"), "n", F.lit(1.0).alias("belief"))
    belief = None
    for k in range(rounds):
        held = sure if belief is None else sure.unionByName(free.join(belief.select("value", "k", "belief"), "value"))
        support = held.groupBy("pattern", "k").agg(F.count_distinct(F.when(F.col("belief") >= CONFIDENCE, F.col("value"))).alias("seeds"), F.sum(F.col("n") * F.col("belief")).alias("hits")).where(F.col("seeds") >= SEEDS)
        scored = support.join(total, "pattern").select("pattern", "k", (F.col("hits") / (F.col("total") + 1)).alias("score")).where(F.col("score") >= CONFIDENCE / 2)
        doubt = F.sum(F.log1p(-F.least("score", F.lit(0.999))))
        belief, seen = shelf.measured(free.join(scored, "pattern").groupBy("value", "k").agg((1 - F.exp(doubt)).alias("belief"), F.max("score").alias("best")), f"belief-{k}", n=F.count_if((F.col("belief") >= CONFIDENCE) & (F.col("best") >= CONFIDENCE)))
        if not seen["n"]:
            return None  # nothing new is believed in, so further rounds would give the same
    found = belief.where((F.col("belief") >= CONFIDENCE) & (F.col("best") >= CONFIDENCE))
    return found.groupBy("value").agg(F.max_by("k", F.struct("belief", "k")).alias("kind"), F.max("belief").alias("belief"))


def find(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, spans_email .. spans_phone, more): base spans of each kind and the spans that the contexts add, array<struct<kind,start,end,value>>."""
    apart(list(keep), ["more", *(f"spans_{k}" for k in KINDS)])
    shelf = Shelf(docs.sparkSession, "pii")
    picked = docs.select(*[F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)], F.col(text_col).cast("string").alias("__text"))
    rows = shelf.put(base(picked, "__text").drop(*([] if text_col in keep else ["__text"])).withColumn("row", F.monotonically_increasing_id()), "rows")
    values = discovered(shelf.put(graph(rows), "edges"), shelf)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    if values is None:
        out = rows.withColumn("more", none)
    else:
        hits = rows.select("row", F.explode("tokens").alias("s")).select("row", "s.start", "s.end", "s.value").join(values, "value").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "value"))).alias("more"))
        out = rows.join(hits, "row", "left")
    return out.select(*[F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)], *[f"spans_{k}" for k in KINDS], F.coalesce("more", none).alias("more"))


def listed(columns: list[Column]) -> Column:
    """kind:start:end of the spans of each kind in turn, comma-joined."""
    parts = [F.transform(c, _written(k)) for k, c in zip(KINDS, columns)]
    return F.array_join(F.concat(*parts), ",")


def every(kind: str) -> Column:
    """Base and further spans of a kind, by start."""
    return F.array_sort(F.concat(F.transform(f"spans_{kind}", lambda s: F.struct(s["start"], s["end"])), F.transform(F.filter("more", lambda s: s["kind"] == kind), lambda s: F.struct(s["start"], s["end"]))))


def report(found: DataFrame, *keep: str) -> DataFrame:
    """(*keep, n_email, n_ip, n_card, n_phone, base_sha256, spans) of what find() gives."""
    return found.select(*keep, *[F.size(f"spans_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS], F.sha2(listed([F.col(f"spans_{k}") for k in KINDS]), 256).alias("base_sha256"), listed([every(k) for k in KINDS]).alias("spans"))


def redacted(found: DataFrame, text_col: str = "text") -> Column:
    """The text of find()'s rows (with the text kept) in which each span is [KIND]; spans that overlap are one, named by the first."""
    marks = F.array_sort(F.concat(*(F.transform(every(k), _marked(k)) for k in KINDS)))
    text = F.col(text_col)

    def put(m: Column) -> Column:
        reach = before(F.transform(m, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
        parts = F.zip_with(m, reach, lambda s, r: F.when(s["start"] >= r, F.concat(F.substring(text, r + 1, s["start"] - r), s["mark"])).otherwise(F.lit("")))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.array_max(F.transform(m, lambda s: s["end"])) + 1, F.length(text)))

    return F.when(F.size(marks) > 0, let(marks, put)).otherwise(text)
