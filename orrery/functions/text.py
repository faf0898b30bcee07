"""Names as columns: cleaning, keys, aliases, slugs.

All of it runs in the JVM. Unicode normalisation and case folding have no SQL function; they
are static methods of the Unicode library that Spark ships, called through ``reflect`` and only
for names that are not ASCII.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions.vocabulary import CORPORATE_SUFFIXES

QUOTES = "\"'`“”‘’ "
_ENDS = f"^[{QUOTES}]+|[{QUOTES}]+$"
#: Names that cleaning leaves alone: visible ASCII without quotes, single spaces inside.
_PLAIN = r"^[!#-&(-_a-~]+( [!#-&(-_a-~]+)*$"


def _beyond_ascii(c: Column) -> Column:
    return c.rlike(r"[^\x00-\x7F]")


def nfkc(c: Column) -> Column:
    return F.when(_beyond_ascii(c), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))).otherwise(c)


def nfkd(c: Column) -> Column:
    return F.when(_beyond_ascii(c), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), c, F.lit(True))).otherwise(c)


def casefold(c: Column) -> Column:
    return F.when(_beyond_ascii(c), F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))).otherwise(F.lower(c))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(c), body), 1)


def clean_name(c: Column, evaluator: bool = False) -> Column:
    """Compatibility-normalised, without quotes around, white space collapsed.

    The evaluator also drops white space that stood inside the quotes.
    """
    return F.when(c.rlike(_PLAIN), c).otherwise(_cleaned(c, evaluator))


def _cleaned(c: Column, evaluator: bool) -> Column:
    out = F.regexp_replace(F.regexp_replace(strip(nfkc(c)), _ENDS, ""), r"(?U)\s+", " ")
    return F.trim(out) if evaluator else out


def canonical_key(c: Column, evaluator: bool = False) -> Column:
    """Key under which names are the same; curly apostrophes and dashes are plain ones."""
    return F.when(c.rlike(_PLAIN), F.lower(c)).otherwise(F.translate(casefold(_cleaned(c, evaluator)), "’–—", "'--"))


def planner_key(c: Column) -> Column:
    return casefold(clean_name(c))


def compact_key(c: Column) -> Column:
    return F.regexp_replace(canonical_key(c, True), r"[^\p{L}\p{N}]", "")


def company_alias_key(c: Column) -> Column:
    """Key without corporate suffixes; of a name that is all suffixes, its compact key less one."""
    bare = F.transform(F.split(canonical_key(c, True), " "), lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))

    def less(compact: Column) -> Column:
        shorter = [F.when(F.endswith(compact, F.lit(s)) & (F.length(compact) > len(s) + 3), F.substring(compact, F.lit(1), F.length(compact) - len(s))) for s in CORPORATE_SUFFIXES]
        return F.coalesce(*shorter, compact)

    def key(tokens: Column) -> Column:
        named = F.array_join(F.filter(tokens, lambda t: (t != "") & ~t.isin(*CORPORATE_SUFFIXES)), "")
        return F.coalesce(F.nullif(named, F.lit("")), let(F.array_join(tokens, ""), less))

    return let(bare, key)


def alias_keys_compatible(a: Column, b: Column) -> Column:
    """Whether two alias keys may name one company: equal, or the shorter (5 at least) begins the longer."""
    begins = lambda long, short: (F.length(short) >= 5) & F.startswith(long, short)
    return (a != "") & (b != "") & ((a == b) | begins(a, b) | begins(b, a))


def companies_compatible(a: Column, b: Column) -> Column:
    keys = F.struct(company_alias_key(a).alias("a"), company_alias_key(b).alias("b"))
    return let(keys, lambda k: alias_keys_compatible(k["a"], k["b"]))


def values_match(a: Column, a_type: Column, b: Column, b_type: Column) -> Column:
    same = canonical_key(a, True) == canonical_key(b, True)
    return (a_type == b_type) & (same | ((a_type == "Company") & companies_compatible(a, b)))


def surface_score(c: Column) -> Column:
    """Orders surfaces of one entity: not shouted, mixed case, longer."""
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    shouted = (F.length(letters) > 4) & (letters == F.upper(letters))
    mixed = c.rlike(r"\p{Lu}") & c.rlike(r"\p{Ll}")
    return F.struct((~shouted).alias("calm"), mixed.alias("mixed"), F.length(c).alias("length"))


def slug(c: Column) -> Column:
    """ASCII letters and digits of a company's name joined by underscores."""
    ascii_ = F.regexp_replace(nfkd(c), r"[^\x00-\x7F]", "")
    out = F.regexp_replace(F.regexp_replace(F.lower(ascii_), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out == "", F.lit("company")).otherwise(out)


def title(c: Column) -> Column:
    """Capitals after every character that is no letter, small letters elsewhere."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def company_from_stem(stem: Column, gold: bool = False) -> Column:
    """A company's name from a file's stem such as ``acme_10k``."""
    spaced = F.replace(F.replace(stem, F.lit("_10k"), F.lit("")), F.lit("_"), F.lit(" "))
    return title(F.trim(F.replace(spaced, F.lit("-"), F.lit(" ")) if gold else spaced))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Probabilities of an array of logits; the temperature is at least 0.001."""
    scaled = F.transform(logits, lambda x: x / F.lit(max(temperature, 1e-3)))
    top = F.array_max(scaled)
    powers = F.transform(scaled, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda t, y: t + y))
