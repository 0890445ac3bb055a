"""PII: base detectors, and bootstrapped extraction that learns the contexts and forms identifiers have.

DataFrame functions only.  Every whole text is scanned once; what later steps read and shuffle are the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace

KINDS = ("email", "ip", "card", "phone")
#: Kinds a learned span may have: those of the base, and secrets (keys, tokens, passwords), which have no base pattern.
LEARNED = (*KINDS, "secret")

#: The contract's patterns.  Possessive loops and a start at the head of a run (or at the end of the last match) find the
#: same matches as the plain forms and keep the scan linear on long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A word with a digit or an at sign: what may turn out to be an identifier.
CANDIDATE = r"(?:\G|(?<![^\x20\x09-\x0D]))[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Words of digits and their punctuation, one blank between two: identifiers written in groups are runs of these.
_DIGITS = r"[+(]{0,2}[0-9][().0-9-]*+(?![^\x20\x09-\x0D,;:!?\]}>\"'])"
GROUPS = rf"(?<![^\x20\x09-\x0D]){_DIGITS}(?:\x20{_DIGITS})++"
_BYTE255 = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?![0-9])"
#: What a candidate must look like to become an identifier of a kind.
SHAPES = {
    "email": r"^[^@]+@[^@]+$",
    "ip": rf"^{_BYTE255}(?:\.{_BYTE255}){{2,}}+$",
    "card": r"^[0-9](?:[ -]?[0-9]){11,}+$",
    "phone": r"^[+(]{0,2}[0-9][ ().0-9-]{5,}[0-9]$",
    "secret": r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9][A-Za-z0-9_+/.=-]{7,}$",
}
#: An assignment within a word (`name=value`, `name:value`), and before one (`name =`, `name=`, `name:`).
_ASSIGNED = r"^([A-Za-z_][A-Za-z0-9_.-]*+)([=:])[\"'(\[{<]*+(?=[^=:/]*[0-9@])(?![=:/])"
_NAMED = r"^(?:[^\x20]+\x20)?([^\x20=:]++)\x20?([=:])$"
#: Sides of a pattern: the word before, the word after, the two words (or the name and its sign) before, the token's own form.
BEFORE, AFTER, TWO, FORM = range(4)
_NEAR = 64
_BLANK, _SOLID = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
_FOUND = "array<struct<kind:string,gap:int,before:string,token:string,after:string>>"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    double = lambda c: F.when(c > 4, 2 * c - 9).otherwise(2 * c)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, double(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: Column, token: Column) -> Column:
    digits = F.regexp_replace(token, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "ip", token.rlike(rf"^{_BYTE255}(?:\.{_BYTE255}){{3}}$"))
        .when(kind == "card", F.when(n.between(16, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(8, 15))
        .otherwise(True)
    )


def _matches(text: Column, kind: str, pattern: str, first: str) -> Column:
    """For each match: the length of the text before it (back to the last match), the last two words of that text (without
    opening punctuation at the match), the match itself, and the first word after it."""
    parts = F.split(text, pattern, -1)
    opening, punctuation = r"(?:[(\[{<\"']++(?=[\x20\x09-\x0D]))?+", r".,;:!?)\]}>\"'"
    two = rf"^{opening}{_BLANK}*+({_SOLID}++(?:{_BLANK}++{_SOLID}++)?+)"
    one = rf"^[{punctuation}]*+{_BLANK}++({_SOLID}++)"
    # a look at the nearest characters is enough where what is sought ends among them; else the whole piece is searched
    whole_two = rf"^{opening}{_BLANK}*+{_SOLID}++{_BLANK}++{_SOLID}++{_BLANK}"
    whole_one = rf"^[{punctuation}]*+(?:{_BLANK}++{_SOLID}++{_BLANK}|[^{punctuation}\x20\x09-\x0D])"

    def last(p: Column) -> Column:
        near = F.reverse(F.substring(p, -_NEAR, _NEAR))
        found = F.when((F.length(p) <= _NEAR) | near.rlike(whole_two), F.regexp_extract(near, two, 1)).otherwise(F.regexp_extract(F.reverse(p), two, 1))
        return F.lower(F.regexp_replace(F.reverse(found), rf"{_BLANK}++", " "))

    def next_(p: Column) -> Column:
        near = F.substring(p, 1, _NEAR)
        return F.lower(F.when((F.length(p) <= _NEAR) | near.rlike(whole_one), F.regexp_extract(near, one, 1)).otherwise(F.regexp_extract(p, one, 1)))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(found, parts, lambda m, p: F.struct(F.lit(kind).alias("kind"), F.length(p).alias("gap"), last(p).alias("before"), m.alias("token")))
    both = F.zip_with(both, F.slice(parts, F.lit(2), F.size(parts)), lambda b, p: F.struct(b["kind"].alias("kind"), b["gap"].alias("gap"), b["before"].alias("before"), b["token"].alias("token"), next_(p).alias("after")))
    # zip_with goes on to the piece after the last match
    return F.when(text.rlike(first), F.slice(both, F.lit(1), F.size(found))).otherwise(F.array().cast(_FOUND))


def _runs(groups: DataFrame) -> DataFrame:
    """Of each group of words of digits: its runs of two words or more with 8 to 19 digits, as candidates."""
    w = Window.partitionBy("row", "run").orderBy("i")
    words = groups.withColumn("start0", F.col("start")).select("row", "text", "run", "start0", "before", "after", F.posexplode(F.split("token", " ")).alias("i", "word"))
    words = words.withColumns({
        "start": F.col("start0") + F.coalesce(F.sum(F.length("word") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "before": F.coalesce(F.concat_ws(" ", F.lag("word", 2).over(w), F.lag("word").over(w)), F.lit("")),
        "head": F.col("before"),
        # a word has a digit, so 19 words have 19 digits or more; one more follows the longest run
        "next": F.collect_list("word").over(w.rowsBetween(0, 19)),
    }).withColumn("before", F.when(F.col("i") == 0, F.col("head")).otherwise(F.col("before")))
    runs = words.withColumn("n", F.explode(F.when(F.size("next") > 1, F.sequence(F.lit(2), F.least(F.size("next"), F.lit(19))))))
    runs = runs.withColumn("after", F.when(F.size("next") > F.col("n"), F.get("next", F.col("n"))).otherwise(F.col("after")))
    runs = runs.withColumn("token", F.regexp_replace(F.array_join(F.slice("next", 1, F.col("n")), " "), r"[.)-]*$", ""))
    runs = runs.where(F.length(F.regexp_replace("token", "[^0-9]", "")).between(8, 19))
    return runs.select("row", "text", F.lit("group").alias("kind"), "before", "token", "after", (F.col("start") + F.length("token")).alias("end"), "start", F.col("start").alias("at"), "run")


def _words(spans: DataFrame) -> DataFrame:
    """Words without the punctuation around them, quoted ones up to the closing quote; of `name=value` and `name:value` the
    value, with the name before it."""
    lead, trail = r"^[(\[{<\"']*", r"[.,;:!?)\]}>\"']*$"
    s = spans.withColumn("text_", F.col("token")).withColumn("cut", F.length(F.regexp_extract("token", lead, 0)))
    s = s.withColumn("bare", F.regexp_replace("token", rf"{lead}|{trail}", ""))
    s = s.withColumn("name", F.concat_ws(" ", *[F.nullif(F.regexp_extract("bare", _ASSIGNED, k), F.lit("")) for k in (1, 2)]))
    skip = F.length(F.regexp_extract("bare", _ASSIGNED, 0))
    s = s.withColumns({"at": F.when(skip > 0, F.col("start") + F.col("cut") + skip).otherwise(F.col("start")), "before": F.when(skip > 0, F.lower("name")).otherwise(F.col("before"))})
    s = s.withColumns({"start": F.col("start") + F.col("cut") + skip, "token": F.substring(F.col("bare"), skip + 1, F.length("bare"))})
    # what follows a closing quote is no part of the value
    quoted = F.substring("text_", 1, F.col("cut") + skip).rlike(r"[\"']$")
    s = s.withColumn("token", F.when(quoted, F.regexp_extract("token", r"^[^\"']*", 0)).otherwise(F.col("token")))
    return s.withColumn("end", F.col("start") + F.length("token")).where("token <> ''").drop("cut", "bare", "name", "text_")


def _seed(kind: Column, token: Column, before: Column) -> Column:
    """Seeds: base spans, and long values of mixed letters and digits that are assigned to a name (secrets)."""
    mixed = token.rlike(r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=-]{20,}$") & (F.size(F.array_distinct(F.split(token, ""))) >= 10)
    return kind.isin(*KINDS) | ((kind == "word") & before.rlike(_NAMED) & mixed)


def _marks(spans: DataFrame) -> DataFrame:
    """Spans by the patterns beside them: a side and its word, the place, and the kinds that the token may have there."""
    token, kind = F.col("token"), F.col("kind")
    base = kind.isin(*KINDS)
    digits = F.length(F.regexp_replace(token, "[^0-9]", ""))
    fit = {k: token.rlike(SHAPES[k]) & ((F.lit(k) != "phone") | ~token.contains(" ") | (digits <= 15)) for k in LEARNED}
    chosen = lambda ok: F.array_compact(F.array(*[F.when(ok(k), F.lit(k)) for k in LEARNED]))
    inner = F.when(base, F.array(kind)).otherwise(chosen(lambda k: fit[k]))
    # a form says nothing against a kind's own test, and of secrets and emails it would say nothing at all
    own = F.when(base, F.array(kind)).otherwise(chosen(lambda k: fit[k] & _valid(F.lit(k), token) if k in ("ip", "card", "phone") else F.lit(False)))
    form = F.when(token.rlike(r"^[+0-9 ().-]+$"), F.translate(token, "012345678", "999999999")).otherwise("")
    two = F.when(F.col("before").rlike(_NAMED), F.concat_ws(" ", *[F.regexp_extract("before", _NAMED, k) for k in (1, 2)])).when(F.col("before").contains(" "), F.col("before")).otherwise("")
    side = lambda n, word, place, kinds: F.struct(F.lit(n).alias("side"), word.alias("word"), place.cast("long").alias("place"), kinds.alias("kinds"))
    sides = [side(BEFORE, F.substring_index("before", " ", -1), F.col("at"), inner), side(AFTER, F.col("after"), F.col("end"), inner), side(TWO, two, F.col("at"), inner), side(FORM, form, F.col("start") * 4096 + F.length(token), own)]
    seed = _seed(kind, token, F.col("before"))
    out = spans.withColumn("seed", seed).select("row", "text", "start", "end", "run", "token", "seed", F.explode(F.array(*sides)).alias("p"))
    return out.select("row", "text", "start", "end", "run", "token", "seed", "p.*").where("word <> ''")


def _learn(ws: Workspace, marks: DataFrame, rounds: int | None, confidence: float, support: int, tolerance: float) -> DataFrame:
    """Accepted patterns: side, word, kind and confidence."""
    # an instance is the longest token of a place; one that repeats beside a pattern counts once, for its text of least hash
    longest = F.max(F.struct(F.length("token").alias("n"), "token"))["token"]
    may = F.collect_list(F.when(F.size("kinds") > 0, F.struct("token", "kinds", "seed")))
    places = marks.groupBy("side", "word", "row", "place").agg(F.xxhash64(longest).alias("instance"), F.min("text").alias("text"), may.alias("may"))
    graph = places.groupBy("side", "word", "instance").agg(F.min("text").alias("text"), F.array_distinct(F.flatten(F.collect_set("may"))).alias("may"))
    graph = ws.table(graph, "graph")
    some = F.when(F.col("side") == FORM, F.exists("may", lambda m: m["seed"])).otherwise(F.size("may") > 0)
    totals = graph.groupBy("side", "word").agg(F.count(F.lit(1)).alias("total"), F.count_if(some).alias("most"))
    # the rest can't become sure, whatever is learned
    totals = totals.where((F.col("most") >= support) & (F.col("most") / (F.col("total") + 0.5) >= confidence))
    edges = graph.join(ws.table(totals.drop("most"), "totals"), ["side", "word"]).select("side", "word", "total", "instance", "text", F.explode("may").alias("m"))
    edges = ws.table(edges.select("side", "word", "total", "instance", "text", "m.token", "m.seed", F.explode("m.kinds").alias("kind")), "edges")

    scores, last, turn = None, None, 0
    while True:
        seeded = F.when(F.col("seed"), 1.0)
        if scores is None:
            held = edges.withColumn("s", F.coalesce(seeded, F.lit(0.0)))
        else:
            # a form counts by its seeds alone
            held = edges.join(scores, ["token", "kind"], "left").withColumn("s", F.coalesce(seeded, F.when(F.col("side") != FORM, F.col("score")), F.lit(0.0)))
        of = held.groupBy("side", "word", "kind", "instance").agg(F.max("s").alias("s"), F.first("text").alias("text"), F.first("total").alias("total"))
        of = of.groupBy("side", "word", "kind").agg(F.round(F.sum("s") / (F.first("total") + 0.5), 9).alias("confidence"), F.countDistinct(F.when(F.col("s") >= 0.5, F.col("text"))).alias("texts"))
        sure = ws.table(of.where((F.col("confidence") >= confidence) & (F.col("texts") >= support)).drop("texts"), "sure")
        turn += 1
        if last is not None:
            old = last.withColumnRenamed("confidence", "old")
            moved = sure.join(old, ["side", "word", "kind"], "full").agg(F.max(F.abs(F.coalesce("confidence", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
            if (moved or 0.0) <= tolerance:
                return sure
        if turn == rounds:
            return sure
        by = edges.join(sure, ["side", "word", "kind"]).groupBy("token", "kind").agg((1 - F.product(1 - F.col("confidence"))).alias("score"))
        scores, last = ws.table(by, "scores"), sure


def extract_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None, confidence: float = 0.8, support: int = 5, tolerance: float = 0.001) -> DataFrame:
    """Personal data in every text: the base spans, and spans found by patterns that are learned.

    Seeds are the base spans of emails, IP addresses, cards and phone numbers, and long values of mixed letters and digits
    that are assigned to a name (secrets).  A lexical pattern is the lower-cased word before, the word after, the two words
    before (`name = value`, `name: value` and `name=value` are one such pattern), or the token's own form (digits as 9).
    Candidates are words with a digit or an at sign, and runs of words of digits (8 to 19 digits in all).

    Patterns and instances (distinct tokens; copies of a passage count once) make a graph.  In each round a pattern's
    confidence for a kind is the sum of its instances' scores over their number and a half; it is accepted with
    `confidence` or more and instances of a score of a half or more from `support` texts or more.  An instance's score is 1
    for seeds, else 1 - the product of (1 - confidence) over the accepted patterns it stands beside, if it has the shape of
    the kind.  Thus what was learned makes new patterns; rounds go on until no confidence moves by more than `tolerance`, or
    for `rounds`.  Forms count by seeds alone and hold for tokens that pass the kind's own test.

    A candidate outside all base spans becomes a span if an accepted pattern stands beside it and it has the shape; of those
    that overlap, the one of the greatest confidence (of all its patterns), then the longest.

    Returns doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans (`kind:start:end` by kind and start,
    comma-joined; code points, end exclusive), n_learned and n_spans.  Null and empty texts have no spans; repeated rows
    are found in each; no span or context is limited by the length of a text or word.
    """
    ws = Workspace(docs.sparkSession, "pii")
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
    found = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    arrays = [_matches(F.col("t"), k, PATTERNS[k], first[k]) for k in KINDS] + [_matches(F.col("t"), "word", CANDIDATE, "[0-9@]"), _matches(F.col("t"), "group", GROUPS, r"[().0-9-]\x20[+(]*[0-9]")]
    rows = found.select("doc_id", F.xxhash64("t").alias("text"), F.when(F.col("t").rlike("[0-9@]"), F.array(*arrays)).otherwise(F.array().cast(f"array<{_FOUND}>")).alias("found")).withColumn("row", F.monotonically_increasing_id())
    rows = ws.table(rows, "found")
    each = rows.select("row", "text", F.explode("found").alias("ms")).select("row", "text", F.posexplode("ms").alias("pos", "m")).select("row", "text", "pos", "m.*")
    w = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("token")).over(w)
    spans = each.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("token")).where(_valid(F.col("kind"), F.col("token"))).drop("pos", "gap")
    spans = spans.withColumns({"at": F.col("start"), "run": F.when(F.col("kind") == "group", F.col("start"))})
    spans = spans.where("kind not in ('word', 'group')").unionByName(_words(spans.where("kind = 'word'"))).unionByName(_runs(spans.where("kind = 'group'")))
    spans = ws.table(spans.select("row", "text", "kind", "at", "start", "end", "run", "before", "after", "token"), "spans")
    base = spans.where("kind not in ('word', 'group')")

    # words that touch no base span: the last end of a base span that starts no later, the first start of one that follows
    line = Window.partitionBy("row").orderBy("start")
    is_base = ~F.col("kind").isin("word", "group")
    reach = F.max(F.when(is_base, F.col("end"))).over(line.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(is_base, F.col("start"))).over(line.rangeBetween(0, Window.unboundedFollowing))
    free = spans.withColumns({"reach": reach, "ahead": ahead}).where(~is_base & (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("ahead", F.col("end")) >= F.col("end")))
    free = ws.table(free.drop("reach", "ahead"), "words")
    marks = _marks(free)
    sure = ws.table(_learn(ws, _marks(base).unionByName(marks), rounds, confidence, support, tolerance), "patterns")
    ws.clear("found", "spans", "words", "patterns")

    near = marks.join(sure, ["side", "word"]).where(F.array_contains("kinds", F.col("kind")))
    learned = near.groupBy("row", "start", "end", "kind").agg(F.round(1 - F.product(1 - F.col("confidence")), 9).alias("c"))
    # candidates that overlap are words of one line of touching candidates
    learned = learned.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("c", "kind")).alias("kind"), F.max("c").alias("c"))
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    learned = learned.withColumn("new", (F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(0))).cast("int"))
    learned = learned.withColumn("line", F.sum("new").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), (F.col("start") - F.col("end")).alias("size"), "start", "end", "kind")))
    clash = lambda kept, x: F.exists(kept, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    none = F.array().cast("array<struct<c:double,size:bigint,start:bigint,end:bigint,kind:string>>")
    learned = learned.groupBy("row", "line").agg(ranked.alias("all"))
    learned = learned.select("row", F.explode(F.aggregate("all", none, lambda kept, x: F.when(clash(kept, x), kept).otherwise(F.concat(kept, F.array(x))))).alias("s")).select("row", "s.start", "s.end", "s.kind")

    both = base.select("row", "kind", "start", "end", F.lit(True).alias("base")).unionByName(learned.select("row", "kind", "start", "end", F.lit(False).alias("base")))
    rank = F.array_position(F.array(*map(F.lit, LEARNED)), F.col("kind"))
    per_row = both.groupBy(F.col("row").alias("of")).agg(
        *[F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{k}") for k in KINDS],
        F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind", "base"))).alias("all"),
    )
    text_of = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n_learned = F.size(F.filter("all", lambda s: ~s["base"])).cast("long")
    per_row = per_row.withColumns({"bases": text_of(F.filter("all", lambda s: s["base"])), "spans": text_of(F.col("all")), "n_learned": n_learned, "n_spans": F.size("all").cast("long")})
    out = rows.select("doc_id", "row").join(per_row.drop("all"), F.col("row") == F.col("of"), "left")
    count = lambda k: F.coalesce(k, F.lit(0)).cast("long").alias(k)
    digest = F.sha2(F.encode(F.coalesce("bases", F.lit("")), "UTF-8"), 256).alias("base_sha256")
    return out.select("doc_id", *[count(f"n_{k}") for k in KINDS], digest, F.coalesce("spans", F.lit("")).alias("spans"), count("n_learned"), count("n_spans"))
