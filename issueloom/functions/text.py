"""Text columns: cleaning, cutting and normal forms. Everything stays in the JVM."""

import json

from pyspark.sql import Column, functions as F

from issueloom.rules import HTML_ENTITIES, TOKEN_PATTERN

# Every character that counts as white space, for trim() character lists.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_RUN = r"[\t-\r\x85\p{Z}]+"
LINE_END = r"\r\n|[\r\n\f\x85\u2028\u2029]"
TAG = "<[^>]*>"
LETTERS_DIGITS_ONLY = r"[^\p{L}\p{Nd}]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def strip_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# One piece of text: an entity or anything else. `chr` wraps at 256, so code points go through UTF-32.
# The map folds into one literal; the lambda is SQL text because that is one call to the JVM, not hundreds.
_DECODE_PIECE = f"""
p -> case
  when not startswith(p, '&') or not endswith(p, ';') then p
  when p rlike '^&#[0-9]{{1,10}};$' or p rlike '^&#[xX][0-9a-fA-F]{{1,8}};$' then coalesce(
    transform(array(case when p rlike '^&#[0-9]' then try_cast(substring(p, 3, length(p) - 3) as bigint)
                         else try_cast(conv(substring(p, 4, length(p) - 4), 16, 10) as bigint) end),
      code -> case when (code > 0 and code < 55296) or (code > 57343 and code <= 1114111)
                   then decode(unhex(lpad(hex(code), 8, '0')), 'UTF-32') end)[0], p)
  else coalesce(try_element_at(from_json({_sql(json.dumps(HTML_ENTITIES))}, 'map<string,string>'),
                               substring(p, 2, length(p) - 2)), p)
end"""


def decode_entities(c: Column) -> Column:
    """Decode character entities once: `&amp;lt;` becomes `&lt;`, not `<`."""
    pieces = F.regexp_extract_all(c, F.lit("(&[^;&]*;|[^&]+|&)"), F.lit(1))
    decoded = F.call_function("transform", pieces, F.expr(_DECODE_PIECE))
    return F.when(c.contains("&"), F.array_join(decoded, "")).otherwise(c)


def clean_text(c: Column) -> Column:
    """Decode entities, turn tags and line ends into spaces, trim. Inner spaces stay."""
    decoded = decode_entities(or_empty(c))
    return strip(F.regexp_replace(F.regexp_replace(decoded, TAG, " "), LINE_END, " "))


def normalize_text(c: Column) -> Column:
    """`clean_text` with every run of white space folded into one space."""
    return strip(F.regexp_replace(clean_text(c), SPACE_RUN, " "))


def compact(c: Column, n: int) -> Column:
    text = clean_text(c)
    return F.when(F.length(text) > n, F.concat(strip_end(text.substr(1, n)), F.lit("..."))).otherwise(text)


def preview(c: Column, n: int) -> Column:
    text = clean_text(c)
    return F.when(F.length(text) > n, F.concat(strip(text.substr(1, n)), F.lit("..."))).otherwise(text)


def compact_display(c: Column, n: int = 260) -> Column:
    """Fold spaces and cut for display; trailing separators go before the dots."""
    text = strip(F.regexp_replace(or_empty(c), SPACE_RUN, " "))
    cut = F.rtrim(text.substr(1, n), F.lit(WHITESPACE + ",.·-"))
    return F.when(F.length(text) > n, F.concat(cut, F.lit("..."))).otherwise(text)


def duplicate_key(source: Column, title: Column, author: Column) -> Column:
    """Articles with the same key count as one."""
    return F.concat_ws(
        "|",
        F.lower(clean_text(source)),
        F.regexp_replace(F.lower(clean_text(title)), LETTERS_DIGITS_ONLY, ""),
        F.when(is_blank(author), F.lit("unknown")).otherwise(F.lower(clean_text(author))),
    )


def normalize_title(c: Column) -> Column:
    folded = F.regexp_replace(or_empty(c), SPACE_RUN, " ")
    return F.lower(strip(F.regexp_replace(folded, r"[^\p{L}\p{N}\s]", "")))


def tokens(c: Column) -> Column:
    """Lower-case runs of two or more Latin letters, digits and Hangul syllables."""
    return F.regexp_extract_all(F.lower(or_empty(c)), F.lit(TOKEN_PATTERN), F.lit(0))


def contains_any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def title_keywords(title: Column) -> Column:
    """The first four space-separated words of two or more characters."""
    return F.slice(F.filter(F.split(title, " "), lambda w: F.length(w) >= 2), 1, 4)


def count_phrase(n: Column) -> Column:
    """`1,234` for 1234."""
    return F.format_number(n, 0)
