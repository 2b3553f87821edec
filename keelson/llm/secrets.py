"""Secret scan with multipart credential linking, in DataFrame functions only.

Base kinds are found by patterns, leftmost and without overlaps, each kind on its own:
``assign`` (a named value of 8 characters or more), ``access`` (an access key id of 16 or
more) and ``hex`` (a run of 32 or more hex digits).

Linking adds credentials whose parts are weak alone. Parts are access identifiers (access
ids, and names given to a user, login or client id), secret candidates (strings of 20 or more
that mix cases and digits, of any length) and endpoints (URLs, host:port, IPv4 addresses). Each part is an
interval of the text. Candidates are joined with the identifiers and the endpoints whose
interval lies within ``scope`` code points of theirs, in the same document, and a candidate
is reported, with its partners, only if both other parts are there. The join runs as a
sorted merge: of the identifiers (endpoints) before and behind a candidate the nearest is
known from a running maximum of ends and minimum of starts, so no pairs are made.

Spans are kind:start:end in code points, the end exclusive.

Defined results: a null text counts as empty and has no spans. Every row gives one result,
also repeated rows and rows with a null id. An empty table gives no rows. Extra columns do
not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Code points between the parts of a credential at most.
SCOPE = 200

# The patterns of the base kinds. Case is spelled out, as in both engines
# case-insensitive matching has its own idea of letters outside ASCII.
_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_KEYS = ("password", "passwd", "secret", "token")
_KEY = "|".join([*map(_either, _KEYS), _either("api") + "_?" + _either("key")])
ASSIGN = f"({_KEY})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"

# The patterns of weak parts. A candidate starts where its run does, so a run is read a fixed number of times, however long.
IDENTIFIER = r"(?<![A-Za-z0-9_])(?:[uU]ser(?:name)?|[lL]ogin|[cC]lient_?[iI]d|[aA]ccess_?[kK]ey_?[iI]d|USER|LOGIN|CLIENT_ID|ACCESS_KEY_ID)[\"']?\x20{0,4}[:=]\x20{0,4}[\"']?[A-Za-z0-9_.@-]{3,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Z])(?=[A-Za-z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"(?<![A-Za-z0-9.-])(?:https?://[A-Za-z0-9.-]{3,253}(?::[0-9]{1,5})?|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9.])|[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}:[0-9]{2,5}(?![0-9]))"

BASE = ("assign", "access", "hex")
LINKED = ("linked_secret", "linked_id", "linked_endpoint")
KINDS = (*BASE, *LINKED)
_PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "identifier": IDENTIFIER, "candidate": CANDIDATE, "endpoint": ENDPOINT}


def _likely(kind: str, text: Column) -> Column:
    """A cheaper test that holds for every text in which the kind's pattern matches."""
    low = F.lower(text)
    if kind == "assign":
        return (low.contains("pass") | low.contains("secret") | low.contains("token") | (low.contains("api") & low.contains("key"))) & text.rlike(ASSIGN)
    if kind == "access":
        return text.contains("AKIA")
    if kind == "hex":
        return text.rlike("[0-9a-f]{32}")
    if kind == "identifier":
        return (low.contains("user") | low.contains("login") | low.contains("client") | low.contains("access")) & text.rlike(IDENTIFIER)
    return text.rlike(_PATTERNS[kind])


def _matches(kind: str, text: Column) -> Column:
    """Per match: the code points before it since the last match, its own, and whether it counts."""
    pattern = F.lit(_PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.transform(F.split(text, _PATTERNS[kind], -1), F.char_length)
    if kind == "assign":
        counts = F.transform(F.regexp_extract_all(text, pattern, F.lit(2)), lambda v: F.char_length(v) >= 8)
    else:
        counts = F.transform(found, lambda m: F.char_length(m) >= (16 if kind == "access" else 0))
    each = F.zip_with(found, between, lambda m, gap: F.struct(F.char_length(m).alias("len"), gap.alias("gap")))
    each = F.zip_with(each, counts, lambda x, ok: F.struct(F.lit(kind).alias("kind"), x["gap"].alias("gap"), x["len"].alias("len"), ok.alias("ok")))
    # split has one part more than there are matches, and that has no length
    empty = F.array().cast("array<struct<kind:string,gap:int,len:int,ok:boolean>>")
    return F.when(_likely(kind, text), F.filter(each, lambda x: x["len"].isNotNull())).otherwise(empty)


def parts(docs: DataFrame, carried: list[str]) -> DataFrame:
    """row_no, kind, start, end, and the columns ``carried`` (in one row of each text; null in its others).

    One row per part; a text without parts, and a match that does not count, have a row with a null kind.
    Needs a row number ``row_no``. Positions are running sums of lengths, by a window over each text's own matches.
    """
    t = docs.select(*carried, "row_no", F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    text = F.col("_text")
    # weak parts matter only where an identifier, an endpoint and a candidate are
    t = t.withColumns({f"_{k}": _matches(k, text) for k in (*BASE, "identifier")})
    none = F.filter("_hex", lambda x: F.lit(False))
    t = t.withColumn("_endpoint", F.when(F.size("_identifier") + F.size("_access") > 0, _matches("endpoint", text)).otherwise(none))
    t = t.withColumn("_candidate", F.when(F.size("_endpoint") > 0, _matches("candidate", text)).otherwise(none))
    weak = F.when(F.size("_candidate") > 0, F.concat("_identifier", "_endpoint", "_candidate")).otherwise(none)
    t = t.select(*carried, "row_no", F.concat(*(f"_{k}" for k in BASE), weak).alias("_found"))
    rows = t.select(*carried, "row_no", F.posexplode_outer("_found").alias("_no", "_m"))
    first = F.coalesce(F.col("_no"), F.lit(0)) == 0
    rows = rows.select(*(F.when(first, F.col(c)).alias(c) for c in carried), "row_no", "_no", "_m.kind", "_m.gap", "_m.len", "_m.ok")
    order = W.partitionBy("row_no", "kind").orderBy("_no").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.repartition("row_no").withColumn("end", F.sum(F.col("gap").cast("long") + F.col("len")).over(order))
    return placed.select(*carried, "row_no", F.when(F.col("ok"), F.col("kind")).alias("kind"), (F.col("end") - F.col("len")).alias("start"), "end")


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``parts`` with the column linked: for candidates, whether an identifier and an endpoint are within the scope; for identifiers and endpoints, whether such a candidate is.

    Interval join by sorted merge: the nearest neighbour on either side decides whether any is within reach.
    """
    up = W.partitionBy("row_no").orderBy("start", "end", "kind").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("row_no").orderBy(F.col("start").desc(), F.col("end").desc(), F.col("kind").desc()).rowsBetween(W.unboundedPreceding, 0)

    def near(which: Column) -> Column:
        before = F.max(F.when(which, F.col("end"))).over(up)
        behind = F.min(F.when(which, F.col("start"))).over(down)
        return F.coalesce(F.col("start") - before <= scope, F.lit(False)) | F.coalesce(behind - F.col("end") <= scope, F.lit(False))

    kind = F.col("kind")
    is_id, is_end = kind.isin("access", "identifier"), kind == "endpoint"
    t = found.withColumn("near_id", near(is_id)).withColumn("near_end", near(is_end))
    t = t.withColumn("secret", (kind == "candidate") & F.col("near_id") & F.col("near_end"))
    partner = near(F.col("secret"))
    return t.withColumn("linked", F.when(kind == "candidate", F.col("secret")).when(kind.isin("identifier", "endpoint"), partner).otherwise(F.lit(False))).drop("near_id", "near_end", "secret")


def spans(docs: DataFrame, carried: list[str], scope: int = SCOPE) -> DataFrame:
    """row_no, kind, start, end of all reported spans, and the carried columns; other rows have a null kind."""
    named = F.create_map(*(F.lit(x) for pair in (("candidate", LINKED[0]), ("identifier", LINKED[1]), ("endpoint", LINKED[2])) for x in pair))
    t = link(parts(docs, carried), scope)
    kind = F.when(F.col("kind").isin(*BASE), F.col("kind")).when(F.col("linked"), named[F.col("kind")])
    return t.select(*carried, "row_no", kind.alias("kind"), "start", "end")


def collected(docs: DataFrame, carried: list[str], scope: int = SCOPE) -> DataFrame:
    """The carried columns and spans, an array of (start, rank of the kind, end), ascending. One row per text."""
    rank = F.array_position(F.lit(list(KINDS)), F.col("kind")) - 1
    item = F.when(F.col("kind").isNotNull(), F.struct(F.col("start"), rank.cast("int").alias("rank"), F.col("end")))
    own = [F.first(c, ignorenulls=True).alias(c) for c in carried]
    return spans(docs, carried, scope).groupBy("row_no").agg(*own, F.array_sort(F.collect_list(item)).alias("spans"))


def _joined(items: Column) -> Column:
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"], x["end"])), ",")


def numbered(docs: DataFrame) -> DataFrame:
    """docs with row_no, which tells repeated rows apart; the same when a lost task runs again."""
    return docs.withColumn("row_no", F.monotonically_increasing_id())


def query(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    t = collected(numbered(docs.select("doc_id", "text")), ["doc_id"], scope)
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    count = lambda *ranks: F.size(F.filter("spans", lambda x: x["rank"].isin(*ranks))).cast("long")
    return t.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        count(*range(len(BASE), len(KINDS))).alias("n_linked"),
    )


def redact(docs: DataFrame, scope: int = SCOPE, mask: str = "[secret]") -> DataFrame:
    """docs with every reported secret, access id and candidate replaced by ``mask``, and n_chars counted anew where a text changed.

    Texts that cannot hold one pass by; the others are shuffled once, along with their spans.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    dirty = _likely("assign", text) | _likely("access", text) | _likely("hex", text) | (_likely("identifier", text) & _likely("endpoint", text))
    rows = numbered(docs.where(dirty).select(F.struct(*docs.columns).alias("_whole"), "text"))
    found = collected(rows, ["_whole"], scope)
    hidden = F.filter("spans", lambda x: x["rank"].isin(0, 1, 2, 3))
    # overlapping spans melt: a clear piece starts only behind the furthest end so far
    state = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("clear"))
    melted = F.aggregate(
        hidden,
        state,
        lambda s, x: F.struct(
            F.greatest(s["end"], x["end"]).alias("end"),
            F.when((x["start"] >= s["end"]), F.array_append(s["clear"], F.struct(s["end"].alias("a"), x["start"].alias("b")))).otherwise(s["clear"]).alias("clear"),
        ),
    )
    body = F.col("_whole.text")
    masked = F.transform("_s.clear", lambda p: F.concat(F.substring(body, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")), F.lit(mask)))
    new = F.when(F.size("_s.clear") > 0, F.concat(F.array_join(masked, ""), F.expr("substring(_whole.text, int(_s.end) + 1)"))).otherwise(body)
    out = found.withColumn("_s", melted).withColumn("_new", new)

    def column(c: str) -> Column:
        if c == "text":
            return F.col("_new").alias(c)
        old = F.col("_whole").getField(c)
        if c == "n_chars":
            return F.when(F.size("_s.clear") > 0, F.char_length("_new").cast(docs.schema[c].dataType)).otherwise(old).alias(c)
        return old.alias(c)

    return docs.where(~dirty).unionByName(out.select(*map(column, docs.columns)))
