"""String predicates and normal forms of cells, labels and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spandrel.functions.numbers import trimmed

#: Labels that mark a total row.
TOTAL_PHRASES = ("excluding certain items", "grand total", "gross profit", "subtotal")
TOTAL_WORDS = ("total", "sum")
#: Layout labels by role; anything else is "Other".
REGION_ROLES = {
    "Table": ("table",),
    "Text": ("text", "paragraph", "title", "section_header", "section-header", "list_item", "list-item"),
    "Figure": ("picture", "figure", "chart", "image"),
    "Caption": ("caption",),
}
DOC_ROLES = {"Title": ("title",), "Heading": ("section_header",), "Caption": ("caption",), "ListItem": ("list_item",), "Paragraph": ("text", "paragraph")}


#: One name for what layout models call by many.
LABELS = {
    "Text": ("text", "plain text", "paragraph", "bibliography", "form"),
    "Title": ("title",),
    "Section-header": ("section-header", "section_header", "sectionheader"),
    "Table": ("table",),
    "Caption": ("table_caption", "figure_caption", "caption", "formula_caption"),
    "Footnote": ("table_footnote", "footnote"),
    "Picture": ("picture", "figure", "chemicalblock", "diagram"),
    "List-item": ("list-item", "list_item", "list", "listgroup", "tableofcontents"),
    "Formula": ("formula", "isolate_formula", "equation", "code"),
    "Page-header": ("page-header", "page_header", "pageheader"),
    "Page-footer": ("page-footer", "page_footer", "abandon", "pagefooter", "blankpage"),
}


def canonical_label(label: Column) -> Column:
    """A layout label under its common name; an unknown one in title case, underscores as spaces."""
    return role_of(label, LABELS, F.initcap(F.replace(label, F.lit("_"), F.lit(" "))))


def percent_decoded(s: Column) -> Column:
    """%XX as bytes and + as a space; a % that no two hex digits follow stays. Bytes that are no UTF-8 become U+FFFD."""
    part = F.regexp_extract_all(s, F.lit("(?s)(%[0-9A-Fa-f]{2}|.)"), F.lit(1))
    code = F.transform(part, lambda x: F.when(x.rlike("^%[0-9A-Fa-f]{2}$"), F.substring(x, 2, 2)).when(x == "+", "20").otherwise(F.hex(F.encode(x, "UTF-8"))))
    return F.make_valid_utf8(F.unhex(F.array_join(code, "")).cast("string"))


def url_encoded(s: Column) -> Column:
    """Letters, digits and -_.~ as they are, every other byte as %XX."""
    part = F.regexp_extract_all(s, F.lit("(?s)([A-Za-z0-9._~-]|.)"), F.lit(1))
    return F.array_join(F.transform(part, lambda x: F.when(x.rlike("^[A-Za-z0-9._~-]$"), x).otherwise(F.regexp_replace(F.hex(F.encode(x, "UTF-8")), "(..)", "%$1"))), "")


def words(s: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")


def clean_cell(s: Column) -> Column:
    """Dot leaders dropped: each part loses its trailing dots, empty parts go."""
    return F.array_join(F.filter(F.transform(words(s), lambda w: F.regexp_replace(w, r"\.+$", "")), lambda w: w != ""), " ")


def residual_tokens(s: Column) -> Column:
    """Lower-case tokens with letters, digits and .-% kept."""
    return F.filter(F.transform(words(s), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}.\-%]", ""))), lambda w: w != "")


def diff_norm(s: Column) -> Column:
    """Form for cell comparison: white space collapsed, $ and commas dropped, lower case."""
    return F.lower(F.regexp_replace(F.array_join(words(s), " "), "[$,]", ""))


def claim_norm(s: Column) -> Column:
    """Form for claim support: no white space, $ or commas; lower case."""
    return F.lower(F.regexp_replace(s, r"(?U)[\s,$]", ""))


def letters_digits(s: Column) -> Column:
    return F.lower(F.regexp_replace(s, r"[^\p{L}\p{N}]", ""))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def has_digit(s: Column) -> Column:
    return s.rlike("[0-9]")


def is_numlike(s: Column) -> Column:
    return s.rlike("[0-9]") & ~s.rlike(r"\p{L}")


def is_symbol_only(s: Column) -> Column:
    return trimmed(s).rlike("^[$€£¥()—–-]+$")


def is_year(s: Column) -> Column:
    t = trimmed(s)
    return F.when(t.rlike("^[0-9]{4}$"), t.cast("int").between(1900, 2100)).otherwise(False)


def is_total_label(s: Column) -> Column:
    """A total's label: one of the phrases anywhere, one of the words anywhere, or "net" as the first word."""
    low = F.lower(s)
    parts = F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    phrase = F.lit(False)
    for p in TOTAL_PHRASES:
        phrase = phrase | F.contains(low, F.lit(p))
    return phrase | F.arrays_overlap(parts, F.array(*map(F.lit, TOTAL_WORDS))) | F.coalesce(F.get(parts, F.lit(0)) == "net", F.lit(False))


def contents_agree(a: Column, b: Column) -> Column:
    """Numbers agree on their digits; other texts when one's letters and digits contain the other's, or are none."""
    x, y = letters_digits(a), letters_digits(b)
    return F.when(is_numlike(a) & is_numlike(b), digits(a) == digits(b)).otherwise((x == "") | (y == "") | F.contains(x, y) | F.contains(y, x))


def escape_html(s: Column, quotes: bool = False) -> Column:
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quotes else ())):
        s = F.replace(s, F.lit(raw), F.lit(code))
    return s


def role_of(label: Column, roles: dict = REGION_ROLES, other: str | Column = "Other") -> Column:
    low, out = F.lower(trimmed(label)), None
    for role, names in roles.items():
        out = F.when(low.isin(*names), role) if out is None else out.when(low.isin(*names), role)
    return out.otherwise(other)


def alnum(s: Column) -> Column:
    """Letters and digits only, lower case: the validator's token form."""
    return F.lower(F.regexp_replace(s, r"[^\p{L}\p{N}]", ""))


def number_sign(s: Column) -> Column:
    """-1, 1, or null for a token without a digit."""
    t = F.lower(F.trim(s))
    negative = t.rlike(r"^\(.*\)$") | t.startswith("-") | t.endswith("-") | t.endswith("cr")
    return F.when(t.rlike("[0-9]"), F.when(negative, -1).otherwise(1))


def truncated(s: Column, n: int) -> Column:
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n - 1)), F.lit("…"))).otherwise(s)


def elapsed(ms: Column) -> Column:
    """Milliseconds as text: 840 ms, 1.2 s or 2m 05s."""
    s = ms / 1000
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).when(s < 60, F.format_string("%.1f s", s.cast("double"))).otherwise(F.format_string("%dm %02ds", F.floor(s / 60), F.floor(s).cast("long") % 60))


def content_id(key: Column, generation: Column) -> Column:
    """The id of an artifact: the first 12 hex digits of its key's SHA-256, and its generation."""
    return F.concat(F.lit("art_"), F.substring(F.sha2(key, 256), 1, 12), F.lit("_"), generation.cast("string"))
