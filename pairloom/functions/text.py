"""Scalar functions over text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PRONOUNS = ("he", "she", "they", "it", "we", "i", "you")
VIEW_PRONOUNS = ("he", "she", "they", "it", "i", "we")
REPORTING = ("say", "tell", "ask", "report", "describe")
REPORTING_FORMS = ("say", "said", "saying", "tell", "told", "speak", "spoke")
COMMUNICATION = ("say", "tell")
HINT_PREPOSITIONS = ("in", "on", "at", "over", "by", "after", "near", "of")
HAVE_FORMS = ("has", "have", "had", "having")
BE_FORMS = ("be", "is", "was", "are", "were")
PREPOSITIONS = (
    "a", "abaft", "aboard", "about", "above", "absent", "across", "afore", "after", "against", "along", "alongside", "amid", "amidst", "among", "amongst", "an",
    "anenst", "apropos", "apud", "around", "as", "aside", "astride", "at", "athwart", "atop", "barring", "before", "behind", "below", "beneath", "beside", "besides",
    "between", "beyond", "but", "by", "circa", "concerning", "despite", "down", "during", "except", "excluding", "failing", "following", "for", "forenenst", "from",
    "given", "in", "including", "inside", "into", "lest", "like", "mid", "midst", "minus", "modulo", "near", "next", "notwithstanding", "of", "off", "on", "onto",
    "opposite", "out", "outside", "over", "pace", "past", "per", "plus", "pro", "qua", "regarding", "round", "sans", "save", "since", "than", "through", "throughout",
    "till", "times", "to", "toward", "towards", "under", "underneath", "unlike", "until", "unto", "up", "upon", "versus", "via", "vice", "with", "within", "without", "worth",
)


def java_hash(text: Column) -> Column:
    """The 32-bit string hash h = 31 h + c, over BMP characters."""
    h = F.aggregate(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii), F.lit(0).cast("bigint"), lambda a, c: F.pmod(a * 31 + c, F.lit(4294967296)))
    return F.when(h >= 2147483648, h - 4294967296).otherwise(h).cast("int")


def plain(text: Column) -> Column:
    """Lower-cased letters and digits alone."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def sentence_hashes(sentence: Column, least_words: int = 5) -> Column:
    """Hash of the sentence, and of every clause of enough words (a blank before the first one makes one more)."""
    clauses = F.filter(F.split(F.lower(sentence), "[.,!?:;]+"), lambda c: F.size(tokens(c)) >= least_words)
    return F.array_distinct(F.transform(F.concat(F.array(sentence), clauses), lambda c: java_hash(plain(c))))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def tokens(text: Column) -> Column:
    """Space tokens, without trailing empty ones."""
    return F.split(F.rtrim(text), " ")


def rewrite_be_have(rel: Column) -> Column:
    """Forms of "have" become had, forms of "be" become be."""
    return F.array_join(F.transform(tokens(rel), lambda t: F.when(t.isin(*HAVE_FORMS), "had").when(t.isin(*BE_FORMS), "be").otherwise(t)), " ")


def strip_be(rel: Column) -> Column:
    return F.regexp_replace(rel, "^be ", "")


def verb_of(rel: Column, prepositions: tuple[str, ...] = PREPOSITIONS) -> Column:
    """The relation without "be" and prepositions, or as it is if nothing is left."""
    left = F.array_join(F.filter(tokens(rel), lambda t: ~t.isin("be", *prepositions)), " ")
    return F.when(left == "", rel).otherwise(left)


def find_span(sentence: Column, part: Column) -> Column:
    """Half-open place of the first occurrence; (0, 0) if there is none."""
    at = F.instr(sentence, part)
    return F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(part)).alias("end"))).otherwise(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))


def common_span(sentence: Column, part: Column) -> Column:
    """Half-open place of the longest common substring of both, the first one in the sentence; (0, 0) for none.

    A part that stands in the sentence as it is needs no search."""
    a = F.trim(part)
    grown = lambda i: F.aggregate(F.sequence(F.lit(1), F.length(a) - i + 1), F.lit(0), lambda n, k: F.when((k == n + 1) & (F.instr(sentence, F.substring(a, i, k)) > 0), k).otherwise(n))
    each = F.transform(F.sequence(F.lit(1), F.length(a)), lambda i: F.struct(grown(i).alias("n"), i.alias("i")))
    found = F.transform(F.filter(each, lambda x: x["n"] > 0), lambda x: F.struct(x["n"].alias("n"), (-F.instr(sentence, F.substring(a, x["i"], x["n"]))).alias("p")))
    best = F.array_max(found)
    whole = find_span(sentence, a)
    none = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    some = F.struct((-best["p"] - 1).alias("start"), (-best["p"] - 1 + best["n"]).alias("end"))
    return F.when(F.length(a) == 0, none).when(F.instr(sentence, a) > 0, whole).when(best.isNull(), none).otherwise(some)


def alnum(text: Column) -> Column:
    return text.rlike("[a-zA-Z0-9]")


def special(text: Column, other: str = ":") -> Column:
    """Has a character outside letters, digits and those of `other`."""
    return text.rlike(f"[^0-9a-zA-Z{other}]")


def replace_special(text: Column, other: str, by: str) -> Column:
    return F.regexp_replace(text, f"[^0-9a-zA-Z{other}]", by)


def has_number(text: Column) -> Column:
    return text.rlike("[0-9]")


def typed(arg1: str, arg2: str) -> Column:
    """Whether either argument is a type."""
    return F.col(arg1).startswith("Type:") | F.col(arg2).startswith("Type:")


def strip_var(arg: Column) -> Column:
    """The argument without the names of variables."""
    return F.regexp_replace(arg, "[XY]VAR:", "")


def pronoun(text: Column, words: tuple[str, ...] = PRONOUNS) -> Column:
    return strip_var(F.trim(text)).isin(*words)


def has_word(rel: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens(rel), F.array(*map(F.lit, words)))


def type_name(arg: Column) -> Column:
    """What follows the first "type:", without ":Number"; empty if there is none."""
    return F.replace(F.regexp_extract(arg, "^(.*?)[tT]ype:(.*)$", 2), F.lit(":Number"), F.lit(""))


def display(arg: Column) -> Column:
    """Types in brackets, XVAR as X."""
    shown = F.when(arg.rlike("[tT]ype:"), F.concat(F.regexp_extract(arg, "^(.*?)[tT]ype:", 1), F.lit("["), type_name(arg), F.lit("]"))).otherwise(arg)
    return F.replace(shown, F.lit("XVAR"), F.lit("X"))


def first_rest(text: Column, sep: str = "\t") -> Column:
    """[before the first separator, after it]; null without one. The separator is literal."""
    at = F.instr(text, F.lit(sep))
    return F.when(at > 0, F.array(F.substring(text, F.lit(1), at - 1), F.substring(text, at + len(sep), F.length(text))))


def nth_field(text: Column, sep: str, n: int) -> Column:
    """Field n from 0, or null; the separator is a regular expression."""
    return F.get(F.split(text, sep), n)


def number_or(text: Column, kind: str, default: float) -> Column:
    return F.coalesce(F.trim(text).try_cast(kind), F.lit(default).cast(kind))


def blocks(text: Column, n: int) -> Column:
    """n blocks of length / n characters, rounded, and the n + 1st: what is left, at most a block of it. The text alone if n < 1."""
    if n < 1:
        return F.array(text)
    size = F.floor(F.length(text) / n + 0.5).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.substring(text, i * size + 1, size))


def window_counts_text(m: Column) -> Column:
    """A window-to-count map as k:v,k:v by window."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")


def _last_wins(entries: Column) -> Column:
    """A map of entries, of which a key's last counts."""
    later = lambda x, i: F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(0))), lambda y: y["key"] == x["key"])
    return F.map_from_entries(F.filter(entries, lambda x, i: ~later(x, i)))


def window_counts_of_text(text: Column) -> Column:
    """The inverse. A malformed entry makes the whole map empty."""
    entries = F.transform(F.filter(F.split(text, ","), lambda p: p != ""), lambda p: F.struct(F.get(F.split(p, ":"), 0).try_cast("int").alias("key"), F.get(F.split(p, ":"), 1).try_cast("int").alias("value")))
    good = F.forall(entries, lambda e: e["key"].isNotNull() & e["value"].isNotNull())
    return _last_wins(F.when(good, entries).otherwise(F.slice(entries, 1, 0)))


def counts_text(m: Column) -> Column:
    """A string-to-count map as text, sorted by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("_CSEP_", e["key"], e["value"].cast("string"))), "_ESEP_")


def counts_of_text(text: Column) -> Column:
    pairs = F.filter(F.split(text, "_ESEP_"), lambda p: p.contains("_CSEP_"))
    entries = F.transform(pairs, lambda p: F.struct(F.split(p, "_CSEP_")[0].alias("key"), F.split(p, "_CSEP_")[1].try_cast("int").alias("value")))
    return _last_wins(F.filter(entries, lambda e: e["value"].isNotNull()))


def map_sum(a: Column, b: Column) -> Column:
    """Two maps of counts as one, with the sums of common keys."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def map_sum_until(a: Column, b: Column, most: int) -> Column:
    """The same while the first map has fewer than `most` keys; then it stays."""
    return F.when(F.size(a) < most, map_sum(a, b)).otherwise(a)


def bumped(counts: Column, key: Column, by: int = 1) -> Column:
    """A map of counts with one key counted up."""
    return map_sum(counts, F.create_map(key, F.lit(by)))


def tuple_key(*parts: str) -> Column:
    """The parts of a tuple, or of a pair, joined by TABs."""
    return F.concat_ws("\t", *parts)


def loose_key(*parts: str) -> Column:
    """The parts without case and outer blanks, joined by commas."""
    return F.concat_ws(",", *[F.lower(F.trim(F.col(p))) for p in parts])


def in_order(a: str, b: str) -> Column:
    """Two texts as (first, second) by their characters."""
    return F.struct(F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))


def escape_html(text: Column) -> Column:
    for c, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def paired(a: Column, b: Column) -> Column:
    """The elements of two arrays side by side; arrays of different sizes are an error."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))).otherwise(F.raise_error(F.lit("arrays of different sizes")))


def chunks(text: Column, size: int) -> Column:
    """Blocks of `size` characters, the last one what is left (empty where nothing is)."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / size)), lambda i: F.substring(text, (i * size + 1).cast("int"), F.lit(size)))
