"""Personal data: rules for four kinds, and bootstrapped contextual extraction of more.

The rules' findings are the seeds, each with its own span. Candidates are spans of what no seed covers, of any length:

- runs of digit groups, as the rules for phones and cards join them, with blanks and without,
- x@y with or without a dot, and x at y, written out or in brackets,
- other tokens with a digit.

A span's *instance* is its own text. Its *patterns* are the word before it, and the word after it, each with the span's shape
(runs of digits and of letters generalised) and, where that word has a letter, with no more than what the span is: a number;
x@y; any address, with @ or at. Patterns and instances form a bipartite graph, weighted by how often they meet. In each round

- a pattern's score is the weighted mean of its instances' scores, with PRIOR more of weight and none of score,
- an instance's score is 1 for a seed, and otherwise 1 - prod(1 - score) over its patterns, weighted.

Rounds end when no pattern's score changes by more than SETTLED. Then patterns of a score of at least CONFIDENT (times the
share of the kind of most of their seeds) that met MET different seeds extract their candidates whole, under that kind; of
spans within each other the longest. Only telling words count: of all places where a word occurs in the corpus, a share of at
least TELLING must stand beside a seed on that side. A word such as "the", which now and then stands before a number and
mostly before something else, is no evidence. All of it is DataFrame and SQL functions. Texts are scanned once for spans
and once to count words; what the rounds exchange are patterns and instances, summed up before each exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuscount.runtime import few, prepare, written

KINDS = ("email", "ip", "card", "phone")
PRIOR, CONFIDENT, MET = 1.0, 0.6, 3
#: Least share of a word's places that stand beside a seed; change of scores at which rounds end, and rounds at most (scores
#: only rise, so they settle).
TELLING, SETTLED, ROUNDS = 0.1, 0.01, 50
#: The patterns of the contract, possessive where that can't change what they match: no deep recursion on long runs.
REGEX = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NUMBER = r"(?:\+|\((?=[0-9]++\)[%s().-]*+[0-9]))?[0-9](?:[%s().-]*+[0-9])*+"
_LOCAL, _HOST = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++", r"[\p{L}\p{N}-]++"
#: Candidates. A token starts at its first letter, digit or plus sign.
SHAPES = {
    "groups": _NUMBER % (r"\x20", r"\x20"),
    "number": _NUMBER % ("", ""),
    "address": rf"{_LOCAL}@{_HOST}(?:\.{_HOST})*+",
    "spelled": rf"{_LOCAL}(?<=[\p{{L}}\p{{N}}])(?:\x20++(?:[Aa][Tt]|@)\x20++|\x20*+(?:\[\x20*+(?:[Aa][Tt]|@)\x20*+\]|\(\x20*+(?:[Aa][Tt]|@)\x20*+\))\x20*+){_HOST}"
    rf"(?:(?:\.|\x20++[Dd][Oo][Tt]\x20++|\x20*+(?:\[\x20*+(?:[Dd][Oo][Tt]|\.)\x20*+\]|\(\x20*+(?:[Dd][Oo][Tt]|\.)\x20*+\))\x20*+){_HOST})*+",
    "token": r"[A-Za-z0-9+][^\s0-9]*+[0-9]\S*+|[0-9]\S*+",
}
#: What a candidate must hold once seeds are cut out of it; no span is in two of these.
_LEFT = {
    "groups": r"t.core rlike '[0-9].*\\x20.*[0-9]'",
    "number": "t.core rlike '[0-9]'",
    "address": r"t.core rlike '[\\p{L}\\p{N}._%+-]@[\\p{L}\\p{N}-]'",
    "spelled": r"t.core rlike '[\\p{L}\\p{N}][\\x20\\[(]+([Aa][Tt]|@)[\\x20\\])]+[\\p{L}\\p{N}-]'",
    "token": r"t.core rlike '[0-9]' and t.core rlike '[^0-9+().-]' and not t.core rlike '[\\p{L}\\p{N}._%+-]@[\\p{L}\\p{N}-]'",
}
PATTERNS = "array<struct<side: string, word: string, what: string>>"
#: Patterns beside the shape, by what a span is.
NUMBER, ADDRESS, ANY_ADDRESS = "\u0002#", "\u0002@", "\u0002at"
COARSE = {"groups": (NUMBER,), "number": (NUMBER,), "address": (ADDRESS, ANY_ADDRESS), "spelled": (ANY_ADDRESS,), "token": (), "email": (ADDRESS, ANY_ADDRESS), "ip": (NUMBER,), "card": (NUMBER,), "phone": (NUMBER,)}
#: Where one of these isn't in a text, its regular expression isn't run.
NEEDS = {"email": "instr(text, '@') > 0", "ip": "digits", "card": "digits", "phone": "digits and instr(text, '+') > 0", "groups": "digits", "number": "digits", "token": "digits", "address": "instr(text, '@') > 0", "spelled": "at"}


def _quoted(regex: str) -> str:
    return "'" + regex.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _last(text: str) -> str:
    """SQL: the last word of a text; empty if it has none."""
    return rf"substring_index(rtrim(translate({text}, '\t\n\u000b\f\r', '     ')), ' ', -1)"


def _first(text: str) -> str:
    """SQL: the first word of a text from a letter or digit on; empty if it has none."""
    return rf"regexp_extract({text}, '^[^\\p{{L}}\\p{{N}}]*([\\p{{L}}\\p{{N}}]\\S*)', 1)"


def located(name: str, regex: str, needs: str) -> str:
    """SQL: array of (start, end, found, before, after) of all matches in ``text``, in code points; before and after are words.

    Starts are sums of the lengths before them: of whole blocks of 64 matches, and within the block.
    """
    r = _quoted(regex)
    return f"""
      transform(array(named_struct(
        'm', case when {needs} then regexp_extract_all(text, {r}, 0) else array() end,
        'g', case when {needs} then split(text, {r}, -1) else array('') end)), x ->
      transform(array(case when size(x.m) = 0 then array() else transform(sequence(0, size(x.m) - 1), i -> length(x.g[i]) + length(x.m[i])) end), lens ->
      transform(array(aggregate(
          case when size(lens) = 0 then array() else sequence(0, (size(lens) - 1) div 64) end, array(0),
          (acc, b) -> concat(acc, array(element_at(acc, -1) + aggregate(slice(lens, cast(b * 64 + 1 as int), 64), 0, (s, v) -> s + v))))), offs ->
      case when size(x.m) = 0 then cast(array() as array<struct<start: int, end: int, found: string, before: string, after: string>>) else
      transform(sequence(0, size(x.m) - 1), i -> named_struct(
        'start', offs[cast(i div 64 as int)] + aggregate(slice(lens, cast((i div 64) * 64 + 1 as int), i % 64), 0, (s, v) -> s + v) + length(x.g[i]),
        'end', offs[cast(i div 64 as int)] + aggregate(slice(lens, cast((i div 64) * 64 + 1 as int), i % 64), 0, (s, v) -> s + v) + length(x.g[i]) + length(x.m[i]),
        'found', x.m[i],
        'before', {_last("concat(case when i > 0 then x.m[i - 1] else '' end, x.g[i])")},
        'after', {_first("concat(x.g[i + 1], case when i < size(x.m) - 1 then x.m[i + 1] else '' end)")})) end)[0])[0])[0] as {name}"""


def _luhn(found: str) -> str:
    d = f"regexp_replace({found}, '[^0-9]', '')"
    return f"""transform(array({d}), d -> length(d) between 13 and 19 and
      aggregate(sequence(1, greatest(length(d), 1)), 0, (s, k) -> s + transform(array(cast(substr(d, length(d) - k + 1, 1) as int) * (2 - k % 2)), v -> cast(v div 10 as int) + v % 10)[0]) % 10 = 0)[0]"""


_HOLDS = {
    "email": "true",
    "ip": r"y.found rlike '^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$'",
    "card": _luhn("y.found"),
    "phone": "length(regexp_replace(y.found, '[^0-9]', '')) between 9 and 15",
}


def with_base_spans(docs: DataFrame) -> DataFrame:
    """docs (with a column ``text``) and for each kind an array of (start, end, found, before)."""
    docs = docs.withColumn("text", F.coalesce(F.col("text"), F.lit(""))).withColumn("digits", F.col("text").rlike("[0-9]"))
    docs = docs.selectExpr("*", *[located(k, REGEX[k], NEEDS[k]) for k in KINDS])
    return docs.withColumns({k: F.expr(f"filter({k}, y -> {_HOLDS[k]})") for k in KINDS})


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def shape(token: Column) -> Column:
    """Letters as one a, up to three digits as one 9, each of more digits as 9; long runs of both mixed (keys, digests) as x."""
    mixed = F.regexp_replace(token, r"(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{12,}", "\u0001")
    short = F.regexp_replace(F.regexp_replace(mixed, r"(?<![0-9])[0-9]{1,3}(?![0-9])", "9"), r"\p{L}+", "a")
    return F.translate(F.regexp_replace(short, "[0-9]{33,}", "9"), "0123456789\u0001", "9999999999x")


def _apart(name: str) -> str:
    """SQL: array of (start, before, core) of what the seeds in ``base`` leave of the spans in ``name``."""
    piece = "substr(r.found, p.start - r.start + 1, p.end - p.start)"
    skip = "length(regexp_extract(" + piece + r", '^(?:[^\\p{L}\\p{N}+(]|\\((?![0-9]+\\)))*', 0))"
    rest = "concat(substr(r.found, p.end - r.start + 1), ' ', r.after)"
    pieces = f"""transform(
      aggregate(array_sort(transform(filter(base, s -> s.start < r.end and r.start < s.end), s -> named_struct('start', s.start, 'end', s.end))),
        named_struct('at', r.start, 'out', cast(array() as array<struct<start: int, end: int>>)),
        (acc, s) -> named_struct('at', greatest(acc.at, s.end), 'out', case when s.start > acc.at then concat(acc.out, array(named_struct('start', acc.at, 'end', s.start))) else acc.out end),
        acc -> case when acc.at < r.end then concat(acc.out, array(named_struct('start', acc.at, 'end', r.end))) else acc.out end),
      p -> named_struct('start', p.start + {skip},
        'before', {_last(f"concat(r.before, ' ', substr(r.found, 1, p.start - r.start + {skip}))")},
        'after', {_first(rest)},
        'core', substr({piece}, {skip} + 1)))"""
    left = f"""transform(flatten(transform({name}, r -> case
      when exists(base, s -> s.start < r.end and r.start < s.end) then {pieces}
      else array(named_struct('start', r.start, 'before', r.before, 'after', r.after, 'core', r.found)) end)),
      t -> named_struct('start', t.start, 'before', t.before, 'after', t.after, 'core', regexp_replace(t.core, '[^\\\\p{{L}}\\\\p{{N}}]+$', '')))"""
    return f"filter({left}, t -> {_LEFT[name]}) as {name}"


def normal(word: Column) -> Column:
    """A word as patterns have it: in lower case, without the numbers in it."""
    return F.regexp_replace(F.lower(word), "[0-9]+", "9")


def telling(texts: DataFrame, tokens: DataFrame, least: float = TELLING) -> DataFrame:
    """(side, word) of the words that tell: of whose places in all of texts (text) a share of at least ``least`` are beside a seed.

    tokens are rows (side, word) of seeds, one for each. Words are counted within tasks before the exchange.
    """
    seeds = tokens.groupBy("side", "word").agg(F.count(F.lit(1)).alias("seeds"))
    words = texts.select(F.explode(F.split(F.regexp_replace(F.lower("text"), "[0-9]+", "9"), r"\s+")).alias("word")).where("word <> ''")
    # a word after a span counts from its first letter or digit on
    words = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    bare = words.select(F.regexp_extract("word", r"^[^\p{L}\p{N}]*(.*)$", 1).alias("word"), "n").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))
    places = words.select(F.lit("before").alias("side"), "word", "n").unionAll(bare.select(F.lit("after").alias("side"), "word", "n"))
    # what is never a word by itself, as in "tel:+44", has no other places; without a letter it tells nothing
    n = F.coalesce("n", F.when(F.col("word").rlike(r"\p{L}"), F.col("seeds")))
    return seeds.join(places, ["side", "word"], "left").where(F.col("seeds") >= least * n).select("side", "word")


def candidates(scanned: DataFrame) -> DataFrame:
    """Adds ``base`` (all seeds) and ``tokens``: array of (start, end, kind of a seed or null, patterns, instance)."""
    lists = "concat(" + ", ".join(f"transform({k}, y -> named_struct('kind', '{k}', 'start', y.start, 'end', y.end))" for k in KINDS) + ")"
    scanned = scanned.withColumn("at", F.col("text").rlike(r"(?<!\p{L})[Aa][Tt](?!\p{L})|[\[( ]@"))
    scanned = scanned.selectExpr("*", f"{lists} as base", *[located(k, SHAPES[k], NEEDS[k]) for k in SHAPES])
    scanned = scanned.selectExpr(*[c for c in scanned.columns if c not in SHAPES], *[_apart(k) for k in SHAPES])

    def span(name: str, core: str) -> Column:
        def one(t: Column) -> Column:
            made = []
            for side in ("before", "after"):
                word = normal(t[side])
                pattern = lambda what: F.struct(F.lit(side).alias("side"), word.alias("word"), what.alias("what"))  # noqa: B023,E731
                exact = F.array(pattern(shape(t[core])))
                if COARSE[name]:
                    exact = F.when(word.rlike(r"\p{L}"), F.concat(exact, F.array(*[pattern(F.lit(c)) for c in COARSE[name]]))).otherwise(exact)
                made.append(F.when(word == "", F.array().cast(PATTERNS)).otherwise(exact))
            return F.struct(
                t["start"].alias("start"),
                (t["start"] + F.length(t[core])).alias("end"),
                F.lit(name if name in KINDS else None).cast("string").alias("kind"),
                F.concat(*made).alias("patterns"),
                F.lower(t[core]).alias("instance"),
            )

        return F.transform(name, one)

    return scanned.withColumn("tokens", F.concat(*[span(k, "found") for k in KINDS], *[span(k, "core") for k in SHAPES])).drop(*SHAPES, "digits", "at")


def learned_patterns(tokens: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, score) of the confident patterns, from rows (pattern, instance, kind or null).

    Every exchange is of sums: by (pattern, instance), then by one of them. The graph is written once and read in each round;
    patterns' scores are written, so that a round starts from a table. A round is one job with two joins, by as many tasks as
    the graph needs: where there are many rounds, many small tasks cost more than the rows.
    """
    edges = written(tokens.groupBy("pattern", "instance", "kind").agg(F.count("*").cast("double").alias("w")))
    n = edges.count()
    met = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("met"))
    best = met.groupBy("pattern").agg(F.max_by("kind", F.struct("met", "kind")).alias("kind"), F.sum("met").alias("met"), (F.max("met") / F.sum("met")).alias("share"))
    open_ = edges.where("kind is null")
    of_seeds = F.sum(F.when(F.col("kind").isNotNull(), F.col("w")).otherwise(0.0))
    scores = edges.groupBy("pattern").agg(F.sum("w").alias("all"), of_seeds.alias("seeds"))
    scores = written(few(scores.withColumn("p", F.col("seeds") / (F.col("all") + PRIOR)), n))
    zero = F.lit(0.0)
    for _ in range(rounds - 1):
        reached = few(open_.join(scores.select("pattern", "p"), "pattern", "left").withColumn("p", F.coalesce("p", zero)), n)
        of_instance = few(reached.groupBy("instance").agg((1 - F.exp(F.sum(F.col("w") * F.log1p(-F.least(F.col("p"), F.lit(0.99)))) / F.sum("w"))).alias("i")), n)
        gained = few(open_.join(of_instance.where("i > 0"), "instance").select("pattern", (F.col("w") * F.col("i")).alias("gained")), n)
        # what a pattern has and what it gains are summed together: one exchange and no join
        rows = scores.select("pattern", "all", "seeds", F.col("p").alias("q"), zero.alias("gained"))
        rows = rows.unionByName(gained.select("pattern", zero.alias("all"), zero.alias("seeds"), zero.alias("q"), "gained"))
        new = rows.groupBy("pattern").agg(*[F.sum(c).alias(c) for c in ("all", "seeds", "q", "gained")])
        new = few(new.withColumn("p", (F.col("seeds") + F.col("gained")) / (F.col("all") + PRIOR)), n)
        # the change is seen as the scores are written
        seen = Observation()
        scores = written(new.observe(seen, F.max(F.abs(F.col("p") - F.col("q"))).alias("moved")).select("pattern", "all", "seeds", "p"))
        if (seen.get["moved"] or 0.0) <= SETTLED:
            break
    return scores.join(best.where(F.col("met") >= MET), "pattern").where(F.col("p") * F.col("share") >= CONFIDENT).select("pattern", "kind", F.col("p").alias("score"))


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Written rows: ``row`` (a number of its own), the kept columns, base spans by kind, ``base`` and ``tokens``."""
    got = candidates(with_base_spans(docs)).select(*keep, *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], "base", "tokens")
    return written(got.withColumn("row", F.monotonically_increasing_id()))


def all_spans(scanned: DataFrame, texts: DataFrame) -> DataFrame:
    """scanned (of texts, with a column ``text``) with ``spans``: base spans and those that the confident patterns add, by kind and start."""
    tokens = scanned.select("row", F.explode("tokens").alias("t")).select("row", "t.*")
    tokens = tokens.select("row", "start", "end", "kind", "instance", F.explode("patterns").alias("pattern"))
    beside = tokens.where("kind is not null").select("row", "start", "pattern.side", "pattern.word").distinct()
    tells = written(telling(texts, beside.select("side", "word")))
    tokens = tokens.join(tells.select(F.col("side").alias("__s"), F.col("word").alias("__w")), (F.col("pattern.side") == F.col("__s")) & (F.col("pattern.word") == F.col("__w"))).drop("__s", "__w")
    patterns = learned_patterns(tokens.select("pattern", "instance", "kind"))
    more = tokens.where("kind is null").drop("kind", "instance").join(patterns, "pattern")
    more = more.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    # of spans within each other the longest
    reach = F.max("end").over(W.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(W.unboundedPreceding, -1))
    more = more.withColumn("reach", reach).where("reach is null or end > reach")
    more = more.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    # rows without an open token have nothing to gain and stay where they are
    gains = F.exists("tokens", lambda t: t["kind"].isNull())
    none = F.expr("cast(array() as array<struct<kind: string, start: int, end: int>>)")
    both = scanned.where(~gains).withColumn("added", none).unionByName(scanned.where(gains).join(more, "row", "left").withColumn("added", F.coalesce("added", none)))
    order = F.create_map(*[F.lit(x) for n, k in enumerate(KINDS) for x in (k, n)])
    key = F.transform(F.concat("base", "added"), lambda s: F.struct(order[s["kind"]].alias("n"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return both.withColumn("spans", F.array_sort(key)).drop("added", "tokens")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in every whole text: id, n_email, n_ip, n_card, n_phone (of the rules), base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by kind (email, ip, card, phone), then start,
    joined by commas; base_sha256 digests those of the rules alone. Null text counts as empty: no
    spans. Equal rows each give their row; other columns of docs are left out; an empty table gives none.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    got = all_spans(scan(rows, [id_col]), rows.select("text"))
    return got.select(id_col, *[f"n_{k}" for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of personal data in the text replaced by its kind in angle brackets, as ``<email>``.

    Overlapping spans are replaced as one, under the kind of the first. Null texts stay null; other columns, row
    counts and clean texts stay as they are.
    """
    prepare(docs.sparkSession)
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("own"), F.col(f"`{text_col}`").alias("text"))
    got = all_spans(scan(packed, ["own"]), packed.select("text"))
    text = F.col("own")[text_col]
    masked = F.expr("""
      aggregate(array_sort(transform(spans, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind))),
        named_struct('at', 0, 'out', cast(array() as array<string>)),
        (acc, s) -> case when s.start < acc.at then named_struct('at', greatest(acc.at, s.end), 'out', acc.out)
          else named_struct('at', s.end, 'out', concat(acc.out, array(substr(t, acc.at + 1, s.start - acc.at), concat('<', s.kind, '>')))) end,
        acc -> concat(array_join(acc.out, ''), substr(t, acc.at + 1)))""".replace("(t,", f"(own.`{text_col}`,"))
    new = F.when(text.isNull() | (F.size("spans") == 0), text).otherwise(masked)
    return got.select(*[new.alias(c) if c == text_col else F.col("own")[c].alias(c) for c in names])
