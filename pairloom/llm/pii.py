"""Surrogates for personal data, by DataFrame and SQL functions alone.

Entities (e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, card
numbers, US social security numbers, IBANs, long secrets, titled person names) are
found by one regular expression; runs of 13 to 19 digits other than 16 are cards
only if they pass the Luhn check. Words of a titled name are replaced wherever else
they stand in the document, too. Each gets a replacement derived from a keyed hash of
its canonical form, so mentions of one entity get one surrogate wherever and
however they are written; the mention's format (punctuation, grouping, letter
case, country prefix), its script and, for names, the gender of the title are
kept; card numbers that pass the Luhn check, and IBANs that pass theirs, keep passing it.

The key comes from the caller or from the setting `pairloom.pii.key`; without
either a random one is drawn for the session, so that nobody can draw the
surrogates of guessed entities again.

A telephone number written with a leading zero and without its country stands for
the one of the corpus with the same national number; ten digits without a zero are
taken for North American ones, nine from 6 to 9 on for Spanish ones. Where numbers of
several countries share a national number, the first keeps its surrogate, and the
others get their own.

Collision checks: the distinct entities and their surrogates are one table.
Where two entities of a type share a surrogate, or a surrogate is itself an
entity of the corpus, all but the first draw again with the next attempt number,
until none does; only documents with such an entity look their surrogates up.
Every attempt draws from a larger space, so this ends however many entities there
are: names get another syllable, e-mail addresses another letter; kinds of a fixed
length get a suffix `x` and digits, one more an attempt, from attempt 8 on.

Defined results: a null text stays null, an empty or clean one unchanged; rows
with null or repeated ids are treated each for itself; an empty table gives an
empty result; all columns pass through, and `redact` adds the number
of mentions under a name that the caller may choose.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

_FEMALE = "Mrs|Ms|Miss|Mme|Mlle|Madame|Mademoiselle|Frau|Señora|Señorita|Sra|Srta|Dame|г-жа"
_NEUTRAL = "Dr|Prof|Professor"
_TITLES = rf"(?:{_FEMALE}|{_NEUTRAL}|Mr|Sir|Monsieur|Herr|Señor|Sr|г-н)"
_H = "[0-9A-Fa-f]{1,4}"
#: Eight groups, or fewer around `::`, of two groups or more and with a digit.
_IPV6 = rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_H}:){{7}}{_H}|(?=[0-9A-Fa-f:]*[0-9])(?:{_H}(?::{_H}){{0,6}}::(?:{_H}(?::{_H}){{0,5}})?|::{_H}(?::{_H}){{1,6}}))(?![\p{{L}}\p{{N}}:]|[.]\d)"
#: Country codes of telephone numbers.
_COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
#: A word of a name: O'Neil-Jones is one.
_WORD = r"\p{Lu}(?:\p{L}+|['\u2019]\p{L}+)(?:['\u2019-]\p{L}+)*"
#: Alternatives in order of precedence.
PATTERN = "|".join(
    (
        r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+",
        r"(?<![\p{L}\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\p{N}]|\.\d)",
        _IPV6,
        r"(?<![\p{L}\p{N}])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
        r"(?<![\p{L}\p{N}])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\p{L}\p{N}]|[ -]\d{1,3}(?![\p{L}\p{N}]))",
        r"(?<![\p{L}\p{N}])(?:\d{4}([ -])\d{4}\2\d{4}\2\d{4}\2\d{1,3}|\d{4}([ -])\d{6}\3\d{4,5})(?![\p{L}\p{N}])",
        r"(?<![\p{L}\p{N}])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3}[ .-]?\d{4}(?![\p{L}\p{N}])",
        r"(?<![\p{L}\p{N}])(?:\+|00(?=[1-9]))\d(?:[ .\-/()\u00a0\u202f]{0,3}\d){6,14}(?![\p{L}\p{N}]|[.]\d)",
        r"(?<![\p{L}\p{N}.,+-])(?:\d{13,15}|\d{17,19})(?![\p{L}\p{N}]|[.,]\d)",
        r"(?<![\p{L}\p{N}(])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\p{L}\p{N}])",
        r"(?<![\p{L}\p{N}.,+-])(?:[2-9]\d{2}[2-9]\d{6}|\([2-9]\d{2}\) ?\d{3}[ .-]?\d{4})(?![\p{L}\p{N}]|[.,]\d)",
        r"(?<![\p{L}\p{N}.,+-])(?!\d{2}[ ./-]\d{2}[ ./-](?:19|20)\d{2}(?!\d))\(?0[1-9](?:[ .\-/()\u00a0\u202f]{0,2}\d){7,10}(?![\p{L}\p{N}]|[.,-]\d)",
        r"(?<![\p{L}\p{N}.,+-])[6-9]\d{2}(?:([ .-]?)\d{3}\4\d{3}|([ .-])\d{2}\5\d{2}\5\d{2})(?![\p{L}\p{N}]|[.,-]\d)",
        r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
        r"(?<![\p{L}\p{N}])(?:[0-9a-fA-F]{32,128}|(?:sk-|ghp_|AKIA)[A-Za-z0-9]{16,})(?![\p{L}\p{N}])",
        r"(?<![\p{L}\p{N}])" + _TITLES + r"\.? " + _WORD + f"(?: {_WORD})?",
    )
)
#: Cheap necessary condition.
HINT = r"[0-9@]|" + _TITLES


def _kind(e: str) -> str:
    return f"""CASE
      WHEN {e} LIKE '%@%' THEN 'email'
      WHEN {e} RLIKE '^{_TITLES}' THEN 'name'
      WHEN {e} RLIKE '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' THEN 'ip'
      WHEN {e} LIKE '%:%' THEN 'ipv6'
      WHEN {e} RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN 'ssn'
      WHEN {e} RLIKE '^([+(]|00[1-9])' AND NOT {e} RLIKE '^[0-9]{{16,}}$' THEN 'phone'
      WHEN {e} RLIKE '^([0-9]{{13,15}}|[0-9]{{17,19}})$' THEN CASE WHEN {_luhn(e)} % 10 = 0 THEN 'card' ELSE 'none' END
      WHEN {e} RLIKE '^([0-9]{{16}}|[0-9]{{4}}[ -][0-9]{{4}}[ -][0-9 -]+|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{4,5}})$' THEN 'card'
      WHEN {e} RLIKE '^([0-9a-fA-F]{{32,}}|sk-.*|ghp_.*|AKIA.*)$' THEN 'secret'
      WHEN {e} RLIKE '^[A-Z]{{2}}[0-9]{{2}}' THEN 'iban'
      ELSE 'phone' END"""


def _expanded(e: str) -> str:
    """All eight groups of an IPv6 address, without leading zeros."""
    part = lambda i: f"filter(split(split(lower({e}), '::', 2)[{i}], ':'), g -> g <> '')"
    whole = f"CASE WHEN {e} LIKE '%::%' THEN concat({part(0)}, array_repeat('0', 8 - size({part(0)}) - size({part(1)})), {part(1)}) ELSE split(lower({e}), ':') END"
    return f"concat_ws(':', transform({whole}, g -> regexp_replace(g, '^0+(?=.)', '')))"


_PREFIX = f"([+]|00(?=[1-9]))(([0-9]{{1,3}})(?=[^0-9])|{_COUNTRY})"


def _base(kind: str, canon: str) -> str:
    """What a surrogate is made of: a telephone number's national part, and else the canonical form."""
    return f"CASE WHEN {kind} = 'phone' THEN substring_index({canon}, '/', 1) ELSE {canon} END"


def _canonical(kind: str, e: str) -> str:
    """One form for all ways to write an entity. The gender of a name is part of it, and so are a telephone
    number's country digits, after a slash, where they are written."""
    return f"""CASE {kind}
      WHEN 'name' THEN concat(
        CASE WHEN {e} RLIKE '^({_FEMALE})[. ]' THEN 'f:' WHEN {e} RLIKE '^({_NEUTRAL})[. ]' THEN 'n:' ELSE 'm:' END,
        lower(regexp_replace({e}, '^{_TITLES}[.]? ', '')))
      WHEN 'email' THEN lower({e})
      WHEN 'secret' THEN {e}
      WHEN 'ip' THEN {e}
      WHEN 'none' THEN {e}
      WHEN 'ipv6' THEN {_expanded(e)}
      WHEN 'iban' THEN replace({e}, ' ', '')
      WHEN 'phone' THEN concat(
        regexp_replace(regexp_replace(regexp_replace({e}, '^{_PREFIX}', ''), '[^0-9]', ''), '^0(?=[0-9])', ''),
        CASE WHEN {e} RLIKE '^{_PREFIX}' THEN regexp_replace(regexp_extract({e}, '^{_PREFIX}', 0), '^([+]|00)', '/')
          WHEN regexp_replace({e}, '[^0-9]', '') RLIKE '^[1-9][0-9]{{9}}$' THEN '/1' WHEN regexp_replace({e}, '[^0-9]', '') RLIKE '^[6-9][0-9]{{8}}$' THEN '/34' ELSE '' END)
      ELSE regexp_replace({e}, '[^0-9]', '') END"""


def _byte(h: str, i: str) -> str:
    """Byte number i (from 0) of a 128-digit hash, around and around."""
    return f"cast(conv(substr({h}, cast(2 * (({i}) % 64) + 1 as int), 2), 16, 10) as int)"


def _swap(s: str, h: str, kept: str) -> str:
    """s with its characters from number `kept` (from 0) on replaced by class and script."""
    c = f"substr({s}, i + 1, 1)"
    b = _byte(h, "i")
    return f"""array_join(transform(sequence(0, greatest(length({s}) - 1, 0)), i -> CASE
      WHEN i < {kept} THEN {c}
      WHEN {c} RLIKE '[0-9]' THEN cast({b} % 10 as string)
      WHEN {c} RLIKE '[a-z]' THEN chr(97 + {b} % 26)
      WHEN {c} RLIKE '[A-Z]' THEN chr(65 + {b} % 26)
      WHEN {c} RLIKE '[\\\\p{{IsCyrillic}}]' THEN substr('абвгдежзиклмнопрстуфхцчшэюя', 1 + {b} % 27, 1)
      WHEN {c} RLIKE '[\\\\p{{IsGreek}}]' THEN substr('αβγδεζηθικλμνξοπρστυφχψω', 1 + {b} % 24, 1)
      WHEN {c} RLIKE '[\\\\p{{L}}]' THEN chr(97 + {b} % 26)
      ELSE {c} END), '')"""


def _luhn(s: str) -> str:
    """Sum of the Luhn check over digits s."""
    return f"""aggregate(sequence(1, length({s})), 0L, (a, i) -> a + CASE WHEN (length({s}) - i) % 2 = 1
      THEN (2 * cast(substr({s}, i, 1) as int)) div 10 + (2 * cast(substr({s}, i, 1) as int)) % 10
      ELSE cast(substr({s}, i, 1) as int) END)"""


def _rest97(s: str) -> str:
    """Rest modulo 97 of an IBAN, with its first four characters moved to the end."""
    moved = f"concat(substr({s}, 5), substr({s}, 1, 4))"
    c = f"substr({moved}, i, 1)"
    return f"""aggregate(sequence(1, length({s})), 0L, (a, i) -> CASE WHEN {c} RLIKE '[0-9]' THEN (a * 10 + cast({c} as int)) % 97 ELSE (a * 100 + ascii({c}) - 55) % 97 END)"""


def _name(s: str, h: str) -> str:
    """Made-up names: as many words, in the script of the original; the ending of
    a given name goes by gender. A word depends on itself alone, so a surname
    keeps its surrogate with and without a given name."""
    words = f"split(substr({s}, 3), ' ')"

    def syllables(own: str, script: str) -> str:
        on, vow = ("бвгдзклмнпрст", "аеиоу") if script == "cyr" else ("bdfgklmnprstv", "aeiou")
        part = lambda i: f"substr('{on}', 1 + {_byte(own, str(i))} % {len(on)}, 1), substr('{vow}', 1 + {_byte(own, str(i + 1))} % 5, 1)"
        return f"concat({part(0)}, {part(2)}, {part(4)})"

    own = f"sha2(concat({h}, w, CASE WHEN j < size({words}) - 1 THEN substr({s}, 1, 2) ELSE '' END), 512)"
    lat, cyr = syllables(own, "lat"), syllables(own, "cyr")
    end = f"""CASE WHEN j = size({words}) - 1 THEN '{{0}}' WHEN {s} LIKE 'f:%' THEN '{{1}}' WHEN {s} LIKE 'm:%' THEN '{{2}}' ELSE '{{3}}' END"""
    return f"""concat(substr({s}, 1, 2), array_join(transform({words}, (w, j) -> CASE WHEN w RLIKE '[\\\\p{{IsCyrillic}}]'
      THEN concat({cyr}, {end.format('к', 'на', 'н', 'л')}) ELSE concat({lat}, {end.format('r', 'na', 'n', 'l')}) END), ' '))"""


def _hash(kind: str, canon: str, attempt: str, key: str) -> str:
    """The keyed hash that a surrogate is drawn from."""
    return f"sha2(concat({key}, {kind}, '/', {canon}, '/', {attempt}), 512)"


def _surrogate(kind: str, canon: str, h: str, salt: str) -> str:
    """The canonical form of the surrogate, from its hash; names go by `salt`, word by word.

    Arguments are names or fields, never long expressions: each is used many times."""
    digits = _swap(canon, h, "0")
    top = f"substring_index({canon}, '.', -1)"
    octets = ", '.', ".join(f"cast(1 + {_byte(h, str(i))} % 254 as string)" for i in range(4))
    kept = f"CASE {kind} WHEN 'iban' THEN 2 WHEN 'secret' THEN 4 ELSE 0 END"
    return f"""CASE
      WHEN {kind} = 'name' THEN {_name(canon, salt)}
      WHEN {kind} = 'none' THEN {canon}
      WHEN {kind} = 'ip' THEN concat({octets})
      WHEN {kind} = 'ipv6' THEN concat_ws(':', transform(sequence(0, 7), i -> regexp_replace(substr({h}, 4 * i + 1, 4), '^0+(?=.)', '')))
      WHEN {kind} = 'email' THEN concat(substr({digits}, 1, length({canon}) - length({top})), {top})
      WHEN {kind} = 'secret' AND {canon} RLIKE '^[0-9a-fA-F]+$' THEN CASE WHEN {canon} RLIKE '[A-F]' THEN upper(substr(concat({h}, {h}), 1, length({canon}))) ELSE substr(concat({h}, {h}), 1, length({canon})) END
      WHEN {kind} = 'card' THEN element_at(transform(array({digits}), d -> CASE WHEN {_luhn(canon)} % 10 = 0
        THEN concat(substr(d, 1, length(d) - 1), cast((10 - ({_luhn("concat(substr(d, 1, length(d) - 1), '0')")} % 10)) % 10 as string)) ELSE d END), 1)
      WHEN {kind} = 'iban' THEN element_at(transform(array({_swap(canon, h, kept)}), d -> CASE WHEN {_rest97(canon)} = 1
        THEN concat(substr(d, 1, 2), lpad(cast(98 - {_rest97("concat(substr(d, 1, 2), '00', substr(d, 5))")} as string), 2, '0'), substr(d, 5)) ELSE d END), 1)
      ELSE {_swap(canon, h, kept)} END"""


def _render(kind: str, e: str, sur: str) -> str:
    """The surrogate in the format of the mention; what a redraw added comes before an e-mail address and after the others."""
    more = f"regexp_extract({sur}, 'x[0-9]+$', 0)"
    return f"CASE WHEN {kind} NOT IN ('name', 'email', 'secret') AND {sur} RLIKE 'x[0-9]+$' THEN concat({_formatted(kind, e, f'regexp_replace({sur}, {chr(39)}x[0-9]+${chr(39)}, {chr(39)*2})')}, {more}) ELSE {_formatted(kind, e, sur)} END"


def _formatted(kind: str, e: str, sur: str) -> str:
    c = f"substr({e}, i + 1, 1)"
    # Digits of the surrogate into the last places of digits; a country prefix stays.
    nth = f"(length(regexp_replace(substr({e}, 1, i + 1), '[^0-9]', '')) - length(regexp_replace({e}, '[^0-9]', '')) + length({sur}))"
    nth_iban = f"length(replace(substr({e}, 1, i + 1), ' ', ''))"
    at = f"i + 1 + length({sur}) - length({e})"
    title = f"regexp_extract({e}, '^({_TITLES}[.]? )', 1)"
    rest = f"substr({e}, length({title}) + 1)"
    return f"""CASE {kind}
      WHEN 'name' THEN concat({title}, CASE WHEN {rest} = upper({rest}) THEN upper(substr({sur}, 3)) ELSE initcap(substr({sur}, 3)) END)
      WHEN 'none' THEN {e}
      WHEN 'ip' THEN {sur}
      WHEN 'ipv6' THEN CASE WHEN {e} RLIKE '[A-F]' THEN upper({sur}) ELSE {sur} END
      WHEN 'secret' THEN {sur}
      WHEN 'email' THEN concat(substr({sur}, 1, length({sur}) - length({e})), array_join(transform(sequence(0, length({e}) - 1), i -> CASE WHEN {c} <> lower({c}) THEN upper(substr({sur}, {at}, 1)) ELSE substr({sur}, {at}, 1) END), ''))
      WHEN 'iban' THEN array_join(transform(sequence(0, length({e}) - 1), i -> CASE WHEN {c} = ' ' THEN ' ' ELSE substr({sur}, {nth_iban}, 1) END), '')
      ELSE array_join(transform(sequence(0, length({e}) - 1), i -> CASE WHEN {c} RLIKE '[0-9]' AND {nth} > 0 THEN substr({sur}, {nth}, 1) ELSE {c} END), '') END"""


def entities(docs: DataFrame) -> DataFrame:
    """kind, canon and row identity (doc_id, text_hash) of every mention."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = rows.where(F.col("text").rlike(HINT)).select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("e"))
    kinds = spans.select("doc_id", "text_hash", "e", F.expr(_kind("e")).alias("kind"))
    return kinds.where("kind <> 'none'").select("doc_id", "text_hash", "kind", F.expr(_canonical("kind", "e")).alias("canon"))


def _quoted(key: str) -> str:
    return "'" + key.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _grown(kind: str, sur: str, h: str, attempt: str) -> str:
    """A surrogate of attempt 0 unchanged, later ones from a space that grows with the attempt."""
    digits = "translate({h}, 'abcdef', '012345')".format(h=h)
    syllables = f"""array_join(transform(sequence(1, {attempt}), i -> CASE WHEN {sur} RLIKE '[\\p{{IsCyrillic}}]$'
      THEN concat(substr('бвгдзклмнпрст', 1 + {_byte(h, '2 * i')} % 13, 1), substr('аеиоу', 1 + {_byte(h, '2 * i + 1')} % 5, 1))
      ELSE concat(substr('bdfgklmnprstv', 1 + {_byte(h, '2 * i')} % 13, 1), substr('aeiou', 1 + {_byte(h, '2 * i + 1')} % 5, 1)) END), '')"""
    letters = f"array_join(transform(sequence(1, {attempt}), i -> chr(97 + {_byte(h, '63 - i')} % 26)), '')"
    return f"""CASE WHEN {attempt} = 0 THEN {sur}
      WHEN {kind} = 'name' THEN concat({sur}, {syllables})
      WHEN {kind} = 'email' THEN concat({letters}, {sur})
      WHEN {attempt} >= 8 THEN concat({sur}, 'x', substr({digits}, 1, {attempt} - 7))
      ELSE {sur} END"""


def dictionary(mentions: DataFrame, key: str) -> DataFrame:
    """kind, canon, attempt, sur: one row an entity, without collisions.

    Names are checked by whole names; telephone numbers by their national parts, which a number written with
    its country and one without may share; the other kinds as they are."""
    quoted = _quoted(key)
    basis = "CASE WHEN alone THEN canon ELSE base END"
    drawn = f"""element_at(transform(transform(array(struct({_hash("kind", basis, "attempt", quoted)} as h, concat({quoted}, attempt) as salt)),
        x -> struct(x.h as h, kind as k, {_surrogate('kind', 'base', 'x.h', 'x.salt')} as s)), x -> {_grown('x.k', 'x.s', 'x.h', 'attempt')}), 1)"""

    table = mentions.select("kind", "canon").distinct().withColumn("base", F.expr(_base("kind", "canon")))
    table = table.withColumn("attempt", F.lit(0)).withColumn("alone", F.lit(False))
    table = written(table.withColumn("sur", F.expr(drawn)), "surrogates")
    while True:
        # Of those that share a surrogate the first entity keeps it: its base, and one canonical form more.
        place = F.struct("base", (F.col("canon") == F.col("base")).alias("bare"), "canon")
        shared = table.groupBy("kind", "sur").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("kind", "sur", "first")
        lost = "base <> first.base OR (canon <> base AND canon <> first.canon)"
        twice = table.join(shared, ["kind", "sur"]).where(lost).select("kind", "canon", F.expr("base = first.base").alias("own"))
        real = table.select("kind", F.col("base").alias("sur")).distinct()
        taken = table.join(real, ["kind", "sur"]).select("kind", "canon", F.lit(False).alias("own"))
        again = twice.unionByName(taken).groupBy("kind", "canon").agg(F.max("own").alias("own"))
        if again.limit(1).count() == 0:
            return table.select("kind", "canon", "attempt", "sur")
        table = table.join(again, ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.col("own").isNotNull().cast("int"))
        table = table.withColumn("alone", F.col("alone") | F.coalesce("own", F.lit(False)))
        table = written(table.withColumn("sur", F.when(F.col("own").isNotNull(), F.expr(drawn)).otherwise(F.col("sur"))).drop("own"), "surrogates")


def _key(spark: SparkSession) -> str:
    """The configured key, or a random one for this session."""
    if not spark.conf.get("pairloom.pii.key", ""):
        spark.conf.set("pairloom.pii.key", secrets.token_hex(32))
    return spark.conf.get("pairloom.pii.key")


def redact(docs: DataFrame, key: str | None = None, count_column: str | None = None) -> DataFrame:
    """docs with surrogates in column text; other columns unchanged."""
    key = key or _key(docs.sparkSession)
    mentions = written(entities(docs), "mentions")
    names = dictionary(mentions, key)
    moved = names.where("attempt > 0").select("kind", "canon", "sur")
    # The caller's columns travel in one struct, apart from the working columns.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row.text").cast("string")
    if moved.limit(1).count():
        own = mentions.join(moved, ["kind", "canon"]).select("doc_id", "text_hash", F.struct(F.concat_ws("/", "kind", "canon").alias("k"), "sur").alias("x")).distinct()
        lookup = written(own.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list("x")).alias("moved_surrogates")), "moved")
        rows = rows.join(lookup, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("text_hash")), "left")
    else:
        rows = rows.withColumn("moved_surrogates", F.lit(None).cast("map<string,string>"))
    spans = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    rows = rows.withColumn("entity_spans", spans)
    quoted = _quoted(key)
    # e: mention, k: kind, c: canonical form, b: its base, h: hash, s: surrogate. Lambda variables bind every step's result once.
    steps = f"""transform(transform(transform(transform(transform(transform(entity_spans,
        x -> struct(x as e, {_kind('x')} as k)),
        x -> struct(x.e as e, x.k as k, {_canonical('x.k', 'x.e')} as c)),
        x -> struct(x.e as e, x.k as k, x.c as c, {_base('x.k', 'x.c')} as b)),
        x -> struct(x.e as e, x.k as k, x.c as c, x.b as b, {_hash('x.k', 'x.b', "'0'", quoted)} as h, concat({quoted}, '0') as salt)),
        x -> struct(x.e as e, x.k as k, coalesce(moved_surrogates[concat_ws('/', x.k, x.c)], {_surrogate('x.k', 'x.b', 'x.h', 'x.salt')}) as s)),
        x -> struct(x.e as e, x.k as k, {_render('x.k', 'x.e', 'x.s')} as r))"""
    pieces = F.split(text, PATTERN, -1)
    rows = rows.withColumn("entity_surrogates", F.when(F.size("entity_spans") > 0, F.expr(steps)))
    # Words of titled names and of their surrogates; where else they stand, they are replaced as well.
    bare = "filter(entity_surrogates, x -> x.k = 'name')"
    words = lambda c: f"split(regexp_replace(x.{c}, '^{_TITLES}[.]? ', ''), ' ')"
    rows = rows.withColumn("name_words", F.expr(f"flatten(transform({bare}, x -> zip_with({words('e')}, {words('r')}, (w, r) -> struct(w, r))))"))
    rows = rows.withColumn("name_pattern", F.expr("CASE WHEN size(name_words) > 0 THEN concat('(?<![\\\\p{L}\\\\p{N}])(?:', array_join(array_distinct(transform(name_words, x -> x.w)), '|'), ')(?![\\\\p{L}\\\\p{N}])') END"))
    rows = rows.withColumn("entity_gaps", F.when(F.size("entity_spans") > 0, pieces))
    hits = "regexp_extract_all(p, name_pattern, 0)"
    swapped = "concat(array_join(zip_with(slice(split(p, name_pattern, -1), 1, size(hs)), transform(hs, y -> element_at(filter(name_words, x -> x.w = y), 1).r), (q, r) -> concat(q, r)), ''), element_at(split(p, name_pattern, -1), -1))"
    bound = f"element_at(transform(array({hits}), hs -> struct({swapped} as t, size(hs) as n)), 1)"
    rows = rows.withColumn("entity_gaps", F.expr(f"transform(entity_gaps, p -> CASE WHEN name_pattern IS NULL THEN struct(p as t, 0 as n) ELSE {bound} END)"))
    new = F.when(
        F.size("entity_spans") > 0,
        F.concat(F.expr("array_join(zip_with(slice(entity_gaps, 1, size(entity_spans)), entity_surrogates, (p, x) -> concat(p.t, x.r)), '')"), F.expr("element_at(entity_gaps, -1).t")),
    ).otherwise(text)
    out = [new.alias(c) if c.lower() == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    if count_column:
        out.append(F.expr("CASE WHEN size(entity_spans) > 0 THEN size(filter(entity_surrogates, x -> x.k <> 'none')) + aggregate(entity_gaps, 0, (a, p) -> a + p.n) ELSE 0 END").alias(count_column))
    return rows.select(*out)

