"""Text scalars: Column -> Column, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that the first evaluator ignores, and the answers' spellings.
IGNORED = ["n/a", "na", "none", "null"]
YES = ["yes", "y", "true", "1"]
NO = ["no", "n", "false", "0"]

#: A class of all that Python takes as white space, no-break and other Unicode blanks included (Java's ``\\s`` lacks them).
WHITE = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_ENDS = rf"^{WHITE}+|{WHITE}+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _ENDS, "")


def norm_text(c: Column) -> Column:
    """Trim, lower, curly to straight quotes, white space collapsed; null becomes empty."""
    lowered = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.regexp_replace(F.translate(lowered, "’“”", "'\"\""), f"{WHITE}+", " ")


def split_multivalue(c: Column, drop_ignored: bool = False) -> Column:
    """The distinct normalised parts of a cell between ``;`` and ``,`` in order; ``drop_ignored`` leaves out n/a, na, none, null."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), rf"{WHITE}*[;,]{WHITE}*"), norm_text)
    kept = F.filter(parts, lambda p: (p != "") & (~p.isin(IGNORED) if drop_ignored else F.lit(True)))
    return F.array_distinct(kept)


def parse_yesno(c: Column, drop_ignored: bool = False) -> Column:
    """yes, no, or the normalised text; of a list the first part decides."""
    text = norm_text(c)
    first = F.get(split_multivalue(text, drop_ignored), 0)
    return F.when(text.isin(YES) | first.isin(YES) & ~text.isin(NO), "yes").when(text.isin(NO) | first.isin(NO), "no").otherwise(text)


def sim_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, of normalised texts (two empty ones: 1)."""
    return _ratio(norm_text(a), norm_text(b))


def _ratio(x: Column, y: Column) -> Column:
    return 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))


def bound(f: Callable[..., Column], *columns: Column) -> Column:
    """f of columns that are computed once a row, however often f's lambdas name them."""
    names = [f"c{i}" for i in range(len(columns))]
    row = F.array(F.struct(*[c.alias(n) for c, n in zip(columns, names, strict=True)]))
    return F.get(F.transform(row, lambda s: f(*[s[n] for n in names])), F.lit(0))


#: Tokens of a side up to which a row of the subsequence table is one number.
_BITS = 60


def _common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def bits(token: Column) -> Column:
        return F.aggregate(F.transform(b, lambda t, j: F.when(t == token, F.call_function("shiftleft", one, j)).otherwise(zero)), zero, lambda s, x: s.bitwiseOR(x))

    def step(v: Column, whole: Column, hit: Column) -> Column:
        return (v + v.bitwiseAND(hit)).bitwiseOR(v - v.bitwiseAND(hit)).bitwiseAND(whole)

    def short(whole: Column) -> Column:  # a bit is cleared where the row of the table rises
        left = F.aggregate(F.transform(a, bits), whole, lambda v, hit: step(v, whole, hit))
        return F.size(b) - F.bit_count(left)

    def row(previous: Column, token: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))),
            F.array(F.lit(0)),
            lambda done, j: F.concat(done, F.array(F.when(F.get(b, j - 1) == token, F.get(previous, j - 1) + 1).otherwise(F.greatest(F.get(previous, j), F.get(done, j - 1))))),
        )

    long = F.element_at(F.aggregate(a, F.array_repeat(F.lit(0), F.size(b) + 1), row), -1)
    return F.when(F.size(b) <= _BITS, bound(short, F.call_function("shiftleft", one, F.size(b)) - 1)).otherwise(long)


def rouge_l(pred: Column, gold: Column) -> Column:
    """struct(p, r, f1) from the longest common subsequence of blank-separated normalised tokens."""
    words = lambda c: F.filter(F.split(norm_text(c), " "), lambda t: t != "")

    def rates(lcs: Column, n: Column, m: Column) -> Column:
        p = F.when(n > 0, lcs / n).otherwise(0.0)
        r = F.when(m > 0, lcs / m).otherwise(0.0)
        return F.struct(p.alias("p"), r.alias("r"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))

    return bound(lambda a, b: bound(rates, _common(a, b), F.size(a), F.size(b)), words(pred), words(gold))


def greedy_pairs(pred: Column, gold: Column, threshold: float = 0.85) -> Column:
    """One-to-one matches of two string arrays, by falling (similarity, place in pred, place in gold), at ``threshold`` or more."""

    def matched(ps: Column, gs: Column) -> Column:
        scored = F.flatten(F.transform(ps, lambda p, i: F.transform(gs, lambda g, j: F.struct(_ratio(p, g).alias("sim"), i.alias("i"), j.alias("j")))))
        ranked = F.reverse(F.array_sort(F.filter(scored, lambda s: s["sim"] >= threshold)))
        empty = F.array().cast("array<struct<sim:double,i:int,j:int>>")
        return F.aggregate(ranked, empty, lambda used, s: F.when(F.exists(used, lambda u: (u["i"] == s["i"]) | (u["j"] == s["j"])), used).otherwise(F.concat(used, F.array(s))))

    return bound(matched, F.transform(pred, norm_text), F.transform(gold, norm_text))


def strip_fences(c: Column) -> Column:
    """Drop a leading code fence (bare, json or JSON) and a trailing one."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), rf"^```(?:json|JSON)?{WHITE}*", ""), rf"{WHITE}*```$", ""))


def lenient_json(c: Column) -> Column:
    """Text of lenient JSON made strict: fences, curly quotes, backticks and trailing commas."""
    return F.regexp_replace(F.translate(strip_fences(c), "’“”`", "'\"\"'"), rf",{WHITE}*([}}\]])", "$1")


def normalize_key(c: Column) -> Column:
    """Lower-case words joined by ``_``; a slash reads ``or``."""
    s = F.replace(F.lower(strip(c)), F.lit("/"), F.lit(" or "))
    kept = F.regexp_replace(F.regexp_replace(s, f"{WHITE}+", " "), "[^a-z0-9 ]+", " ")
    return F.regexp_replace(F.regexp_replace(kept, " +", "_"), "^_+|_+$", "")


def normalize_key_hyphen(c: Column) -> Column:
    """The variant that keeps hyphens and drops other signs."""
    s = F.translate(F.regexp_replace(strip(c), f"{WHITE}+", " "), "/\\–—", "  --")
    return F.replace(F.lower(strip(F.regexp_replace(s, r"[^0-9A-Za-z _\-]+", ""))), F.lit(" "), F.lit("_"))


def allowed_answers(c: Column, integers: bool = True) -> Column:
    """struct(type, enum) of an allowed-answers cell: ``integer``, or ``string`` with its distinct values, or nulls."""
    text = strip(F.coalesce(c, F.lit("")))
    cleaned = F.regexp_replace(F.translate(text, "’`", "''"), "^'+|'+$", "")
    parts = F.transform(F.split(cleaned, rf"{WHITE}*[;,]{WHITE}*"), lambda p: strip(F.regexp_replace(F.regexp_replace(strip(p), "^'+|'+$", ""), '^"+|"+$', "")))
    parts = F.filter(parts, lambda p: p != "")
    distinct = F.aggregate(parts, F.filter(parts, lambda p: F.lit(False)), lambda seen, p: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(p)), seen).otherwise(F.concat(seen, F.array(p))))
    is_integer = F.lower(text).isin("integer", "int") if integers else F.lit(False)
    return F.struct(
        F.when(is_integer, "integer").when(F.size(distinct) > 0, "string").alias("type"),
        F.when(~is_integer & (F.size(distinct) > 0), distinct).alias("enum"),
    )


def title_abstract(c: Column) -> Column:
    """struct(title, abstract) of a merged text ``Title: ...`` / ``Abstract: ...``; without a marked title a first line of at most 200 characters is the title."""
    text = strip(F.coalesce(c, F.lit("")))
    title = strip(F.regexp_extract(text, rf"(?is)title:{WHITE}*(.+?)(?:\n+|\z)", 1))
    first = F.get(F.split(text, r"\r\n|[\n\r]"), F.lit(0))
    short = F.when(F.length(first) <= 200, strip(F.regexp_replace(first, rf"(?i)^title:{WHITE}*", ""))).otherwise("")
    return F.struct(F.when(title != "", title).otherwise(short).alias("title"), strip(F.regexp_extract(text, rf"(?is)abstract:{WHITE}*(.+)\z", 1)).alias("abstract"))


def iri_safe(c: Column) -> Column:
    """Percent-encode what an IRI template must: all but letters, digits, ``-._~`` and non-ASCII characters."""
    encoded = F.url_encode(c)
    spaced = F.replace(F.replace(encoded, F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    ascii_only = F.replace(spaced, F.lit("*"), F.lit("%2A"))
    # Non-ASCII characters stay as they are: encode character by character only where there are some.
    each = F.array_join(F.transform(F.split(c, ""), lambda ch: F.when(ch.rlike(r"^[^\x00-\x7F]"), ch).otherwise(F.replace(F.replace(F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")))), "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), each).otherwise(ascii_only)


def first_word(c: Column) -> Column:
    """First word of a model's answer without punctuation around it."""
    return F.regexp_replace(F.get(F.split(strip(c), f"{WHITE}+"), 0), r"^[\p{Punct}]+|[\p{Punct}]+$", "")


def word_list(c: Column) -> Column:
    """Parts of a comma list, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda p: p != "")
