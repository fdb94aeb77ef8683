"""Secret scans: candidates in texts, told apart by how many owners share them.

Candidates are found by regular expressions with their places in the text. A candidate's
value is hashed; over the whole corpus each hash is counted by distinct owners and documents
(repositories) that hold it. A value that at least WIDE_OWNERS owners share is a copied
example, any other one is owner-specific and taken as live. Besides the base kinds, long
mixed tokens without a keyword are candidates too; they become spans only when they are
owner-specific, since without a keyword nothing else speaks for them.

Counting goes by (hash, owner, document), then (hash, owner), then hash, each with map-side
combining, so a value that a third of all rows hold is never gathered in one task. Texts are
scanned once: the result of the scan is written with a row number, and only rows with
candidates meet the counts.

Cases: null texts count as empty and have no spans; null owners count as one owner; repeated
rows are repeated in the result; places count code points, ends are exclusive. Columns that
are not kept do not travel; kept columns with the name of a result column are replaced. Spans
that begin at the same place come in the order of KINDS. Texts are scanned whole. An empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

#: From so many distinct owners on, a value is a copied example.
WIDE_OWNERS = 4

# The base patterns and least lengths.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

#: Runs of this many characters with small and capital letters and digits are candidates of kind token.
TOKEN_LEAST = 24
TOKEN = rf"[A-Za-z0-9_-]{{{TOKEN_LEAST},}}"
#: Matches of a text whose places are summed up together.
PART = 128
KINDS = ("assign", "access", "hex", "token")

_SPAN = "array<struct<start:int,kind_no:int,end:int,hash:string>>"


def _places(text: Column, pattern: str, value_group: int) -> Column:
    """start, end and value of all matches, leftmost and non-overlapping.

    The texts between the matches and the matches themselves give the places, summed up in
    parts of PART matches: appending to an array copies it, so parts stay short.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    lengths = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(whole, F.length).alias("own"), value.alias("value")
    )
    width = lambda x: x["gap"] + F.coalesce(x["own"], F.lit(0))

    def found(part: Column, at: Column) -> Column:
        """Matches of a part that begins at a place."""
        start = F.struct(at.alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("found"))

        def step(acc: Column, x: Column) -> Column:
            begin, end = acc["at"] + x["gap"], acc["at"] + width(x)
            one = F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))
            return F.struct(end.alias("at"), F.when(x["own"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(one))).alias("found"))

        return F.aggregate(part, start, step)["found"]

    def in_parts(every: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / PART).cast("int")), lambda k: F.slice(every, k * PART + 1, F.lit(PART)))
        return F.transform(F.array(parts), placed)[0]

    def placed(parts: Column) -> Column:
        lengths = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + width(x)))
        starts = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.flatten(F.zip_with(parts, F.slice(starts, F.lit(1), F.size(parts)), found))

    # arrays of one bind a value to a name, so that nothing is matched again for each part
    return F.transform(F.array(lengths), in_parts)[0]


def _spans(text: Column, kind: str, pattern: str, quick: str, group: int, keep) -> Column:
    """Spans of a kind, looked for only where the cheap pattern quick is met."""
    number = KINDS.index(kind)
    found = F.filter(_places(text, pattern, group), keep)
    made = F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), F.lit(number).alias("kind_no"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("hash")))
    return F.when(F.rlike(text, F.lit(quick)), made).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def base_spans(text: Column) -> Column:
    """All spans of the base kinds, by start and kind."""
    assign = _spans(text, "assign", ASSIGN, ASSIGN, 2, lambda x: F.length(x["value"]) >= ASSIGN_LEAST)
    access = _spans(text, "access", ACCESS, rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}", 0, lambda x: F.length(x["value"]) >= ACCESS_LEAST)
    # a run of at least so many characters is the same match as a long enough run of any length
    runs = rf"[0-9a-f]{{{HEX_LEAST},}}"
    return F.array_sort(F.concat(assign, access, _spans(text, "hex", runs, runs, 0, lambda x: F.lit(True))))


def _token_spans(text: Column, base: Column) -> Column:
    def mixed(x: Column) -> Column:
        return F.rlike(x["value"], F.lit("[0-9]")) & F.rlike(x["value"], F.lit("[a-z]")) & F.rlike(x["value"], F.lit("[A-Z]"))

    found = _spans(text, "token", TOKEN, TOKEN, 0, mixed)
    return F.filter(found, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))


def _of_kind(number: int):
    return lambda s: s["kind_no"] == number


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"], s["end"])), ",")


def owner_counts(candidates: DataFrame) -> DataFrame:
    """(hash, owner, repo) to (hash, owners, repos), distinct ones counted."""
    pairs = candidates.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("_one"))
    owners = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))


def scan_secrets(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """Adds n_assign, n_access, n_hex, base_sha256, found (spans with hash, owners, repos, live) and spans (text)."""
    made = ("n_assign", "n_access", "n_hex", "base_sha256", "found", "spans")
    kept = [c for c in keep if c not in made]
    content = F.coalesce(F.col(text), F.lit(""))
    scanned = docs.select(
        *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.col(repo).cast("string").alias("repo"), content.alias("_text"),
    ).withColumn("base", base_spans(F.col("_text"))).withColumn("more", _token_spans(F.col("_text"), F.col("base"))).drop("_text")
    rows = written(scanned.withColumn("row", F.monotonically_increasing_id()), "secrets")
    one = rows.where("size(base) + size(more) > 0").select("row", "owner", "repo", F.explode(F.concat("base", "more")).alias("s"))
    counts = owner_counts(one.select(F.col("s.hash").alias("hash"), "owner", "repo"))
    judged = one.select("row", "s", F.col("s.hash").alias("hash")).join(counts, "hash").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("s.start", "s.kind_no", "s.end", "s.hash", "owners", "repos", (F.col("owners") < WIDE_OWNERS).alias("live")))).alias("found")
    )
    none = F.array().cast(judged.schema["found"].dataType)
    # rows without candidates, nearly all of them, do not travel
    out = rows.where("size(base) + size(more) = 0").withColumn("found", none).unionByName(rows.where("size(base) + size(more) > 0").join(judged, "row"))
    kind = F.array(*map(F.lit, KINDS))
    valid = F.filter("found", lambda s: (s["kind_no"] < 3) | s["live"])
    named = F.transform(valid, lambda s: F.struct(F.element_at(kind, s["kind_no"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hash"].alias("hash"), s["owners"].alias("owners"), s["repos"].alias("repos"), s["live"].alias("live")))
    return out.select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(kept)),
        *(F.size(F.filter("base", _of_kind(n))).cast("long").alias(f"n_{KINDS[n]}") for n in range(3)),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), named.alias("found"), span_text(valid).alias("spans"),
    )


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with the live spans replaced; overlapping ones by a single mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        out = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, out).otherwise(acc["out"]).alias("out"))

    live = F.filter(found, lambda s: s["live"])
    done = F.aggregate(live, start, step)
    return F.when(F.size(live) == 0, text).otherwise(F.concat(done["out"], F.substr(text, done["at"] + 1)))
