"""Text functions: Column -> Column, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide results.
TOKEN = "[a-z0-9]+"
NOT_WORD = r"[^\p{L}\p{N}_\s\p{Z}]"
BLANKS = r"[\s\p{Z}]+"
NUMBER = r"-?[0-9][0-9,]*(?:\.[0-9]+)?"
FACT = r"[A-Z]{2,3}-[0-9]{3}|[0-9][0-9,]*(?:\.[0-9]+)?"
CURRENCY = "$€£"

# Document kinds by id prefix, and their labels.
KINDS = {"HR": "hr", "PRD": "product", "PRC": "pricing", "INC": "incident", "ORG": "org"}
KIND_LABELS = {"hr": "HR policy", "product": "Product specification", "pricing": "Pricing", "incident": "Incident postmortem", "org": "Org chart"}


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def normalize(text: Column) -> Column:
    """Lower case without punctuation, blanks collapsed."""
    return collapse(F.regexp_replace(F.lower(text), NOT_WORD, ""))


def _folds() -> tuple[str, str, dict[str, str]]:
    """Full case folding of every code point, from the interpreter's own Unicode tables: characters that fold to one, what they fold to, and those that fold to several."""
    changed = {c: f for c in map(chr, range(0x110000)) if (f := c.casefold()) != c}
    single = [c for c, f in changed.items() if len(f) == 1]
    return "".join(single), "".join(changed[c] for c in single), {c: f for c, f in changed.items() if len(f) > 1}


ONE, FOLDED, SEVERAL = _folds()


def fold(text: Column) -> Column:
    """Case folding over all of Unicode: final sigma is sigma, the sharp s is ss, the dotted capital I is i and a combining dot, ligatures are their letters.

    What a character folds to folds to itself, so the order of both steps does not matter. The second step runs over texts that hold one of its characters only.
    """
    once = F.translate(text, ONE, FOLDED)
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c, f in SEVERAL.items()])
    return F.when(once.rlike(f"[{''.join(SEVERAL)}]"), F.aggregate(pairs, once, lambda t, p: F.replace(t, p["c"], p["f"]))).otherwise(once)


def normalize_answer(text: Column) -> Column:
    """Case folding without punctuation, blanks collapsed."""
    return collapse(F.regexp_replace(fold(text), NOT_WORD, ""))


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct character n-grams; a shorter text is its own only shingle."""
    grams = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
    return F.when(F.length(text) < n, F.array(text)).otherwise(grams)


def first_number(text: Column) -> Column:
    """The first number after currency signs are removed; null if there is none."""
    found = F.regexp_extract(F.translate(text, CURRENCY, ""), NUMBER, 0)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def match_answer(answer: Column, reference: Column, kind: Column) -> Column:
    """exact: equal when normalised; numeric: within 0.5 % or 0.01, whichever is wider; other kinds never match."""
    a, r = first_number(answer), first_number(reference)
    near = F.coalesce(F.abs(a - r) <= F.greatest(F.lit(0.005) * F.abs(r), F.lit(0.01)), F.lit(False))
    return F.when(kind == "exact", F.coalesce(normalize_answer(answer) == normalize_answer(reference), F.lit(False))).when(kind == "numeric", near).otherwise(F.lit(False))


def facts_signature(text: Column) -> Column:
    """Document ids and numbers, without thousands commas, sorted."""
    return F.array_sort(F.transform(F.regexp_extract_all(text, F.lit(FACT), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(""))))


def fact_sentences(body: Column, boilerplate: list[str]) -> Column:
    """Non-empty trimmed lines that begin with none of `boilerplate`."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(x))

    def wanted(x):
        ok = x != ""
        for p in boilerplate:
            ok = ok & ~F.startswith(x, F.lit(p))
        return ok

    return F.filter(lines, wanted)


def length_x(perturbed: Column, original: Column) -> Column:
    """Change of length in units of +50 %; null for an empty original."""
    return F.log(F.length(perturbed) / F.nullif(F.length(original), F.lit(0))) / F.log(F.lit(1.5))


def kind_of(doc_id: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.element_at(table, F.element_at(F.split(doc_id, "-"), 1))


def model_family(model: Column) -> Column:
    """Vendor path and version removed: 'x/Name-4-5' is 'name'."""
    return F.lower(F.element_at(F.split(F.element_at(F.split(model, "/"), -1), "-"), 1))


def sha256(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data.cast("binary"), 256))


def bar(fraction: Column, width: int = 20) -> Column:
    n = F.greatest(F.lit(0), F.least(F.lit(width), F.floor(fraction * width))).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))
