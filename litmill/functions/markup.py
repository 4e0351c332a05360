"""HTML and sentence rules as built-in expressions."""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from litmill.functions import text

# Tags that break lines.
BLOCK_TAGS = ("br", "p", "div", "h1", "h2", "h3", "h4", "li")
# Characters that end a sentence, and script in which no blank follows them.
TERMINATORS = ".!?\u3002\uff01\uff1f"
UNSPACED = "\u4e00-\u9fff"
# Abbreviations meant not to end a sentence.
ABBREVIATIONS = ("et al.", "e.g.", "i.e.", "vs.", "dr.", "fig.", "no.", "inc.", "approx.")

_LINE_ENDS = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def _character(code: Column) -> Column:
    """Character of a code point; null where there is none."""
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


# Names that are read without a semicolon too: the table lists them both ways.
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
# What numbers stand for that name no character of their own (Windows letters of old pages).
_OLD = {k: bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0)}


def decode_entities(c: Column) -> Column:
    """Character references become characters, as HTML reads them.

    Every name of the HTML table is known; the older ones are read without a
    semicolon too, the longest that fits.  A number without a character becomes
    U+FFFD; what is no reference stays.
    """
    # Maps are read from end to end, so names go by their first letter and whole texts without a reference are let by.
    letters: dict[str, dict[str, str]] = {}
    for name, chars in html5.items():
        letters.setdefault(name[0], {})[name] = chars
    names = F.from_json(F.lit(json.dumps(letters)), "map<string,map<string,string>>")
    old = F.create_map(*[F.lit(x) for kv in _OLD.items() for x in kv])
    find = lambda name: F.try_element_at(F.try_element_at(names, F.left(name, F.lit(1))), name)

    def numbered(part: Column) -> Column:
        number = F.regexp_extract(part, r"^&#(?:[0-9]+|[xX][0-9A-Fa-f]+);?", 0)
        digits = F.regexp_replace(number, r"^&#[xX]?0*|;$", "")
        code = F.when(F.length(digits) > 7, 0x110000).otherwise(
            F.when(part.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        )
        code = F.coalesce(code, F.lit(0))
        char = F.coalesce(F.try_element_at(old, code), _character(code), F.lit("\ufffd"))
        return F.when(number == "", part).otherwise(F.concat(char, F.substring(part, F.length(number) + 1, F.length(part))))

    def named(part: Column) -> Column:
        whole = F.regexp_extract(part, "^&([A-Za-z][A-Za-z0-9]*;)", 1)
        bare = F.regexp_extract(part, f"^&({'|'.join(_BARE)})", 1)
        rest = lambda name: F.substring(part, F.length(name) + 2, F.length(part))
        return F.coalesce(F.concat(find(whole), rest(whole)), F.concat(find(bare), rest(bare)), part)

    def one(part: Column) -> Column:
        return F.when(part.startswith("&#"), numbered(part)).when(part.startswith("&"), named(part)).otherwise(part)

    return F.array_join(F.transform(F.split(c, r"(?=&#?[0-9A-Za-z])"), one), "")


# The rest of a tag: a quoted value may hold any sign.  Java recurses for each round of the group, hence its bound;
# a tag with more values ends at its first closing sign.
_REST = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+){0,300}+>"""
_RAW = "script|style"
# White space that is not one blank already.
_ODD_SPACE = f" {text.SPACE}+|[{text.SPACE}&&[^ ]]{text.SPACE}*"


def html_text(c: Column) -> Column:
    """HTML fragment to text: block tags break lines, references decoded, white space collapsed, blank lines dropped.

    Comments and declarations go with the tags; the content of scripts and
    style sheets is plain text, signs and references in it included.  Null for
    a fragment without text.
    """
    bare = F.regexp_replace(c, r"(?s)<!--.*?(?:-->|\z)", "")
    cut = rf"(?i)(?=<(?:{_RAW})[\s/>])|(?<=</script>)|(?<=</style>)"
    # One look for a tag to cut at spares most texts the search at every place.
    whole_or_cut = lambda x: F.when(x.rlike(rf"(?i)</?(?:{_RAW})[\s/>]"), F.split(x, cut)).otherwise(F.array(x))

    def plain(x: Column) -> Column:
        x = F.regexp_replace(x, "<[!?][^>]*>|</[^A-Za-z>][^>]*>", "")
        x = F.regexp_replace(x, rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})(?=[\s/>]){_REST}", "\n")
        x = F.regexp_replace(x, f"</?[A-Za-z]{_REST}|</?[A-Za-z][^>]*>", "")
        return decode_entities(x)

    def raw(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(x, f"^<[A-Za-z]{_REST}", ""), rf"(?i)</(?:{_RAW})>$", "")

    def read(x: Column) -> Column:
        done = F.transform(whole_or_cut(x), lambda x: F.when(x.rlike(rf"^(?i)<(?:{_RAW})[\s/>]"), raw(x)).otherwise(plain(x)))
        lines = F.transform(F.split(F.array_join(done, ""), _LINE_ENDS), lambda x: F.trim(F.regexp_replace(x, _ODD_SPACE, " ")))
        return F.array_join(F.filter(lines, lambda x: x != ""), "\n")

    # A list of one, so that the fragment is read once for the test and for the result.
    return F.get(F.filter(F.transform(F.array(bare), read), lambda x: x != ""), F.lit(0))


def sentence_bounds(c: Column, guard_abbreviations: bool = False) -> Column:
    """Flat array of sentence starts and ends (offsets into the text, ends exclusive).

    A sentence ends after a terminator before white space or unspaced script.
    The default splits after every terminator, abbreviations included, as the
    offsets of stored spans expect; ``guard_abbreviations`` keeps them together.
    """
    guard = ""
    if guard_abbreviations:
        guard = f"(?<!(?i:{'|'.join(re.escape(a) for a in ABBREVIATIONS)}))"
    cut = rf"(?<=[{TERMINATORS}]){guard}(?={text.SPACE}|[{UNSPACED}])"
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        head = F.length(piece) - F.length(F.regexp_replace(piece, f"^{text.SPACE}+", ""))
        body = F.length(text.strip(piece))
        start = acc["at"] + head
        more = F.concat(acc["out"], F.array(start, start + body))
        return F.struct(end.alias("at"), F.when(body > 0, more).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.split(c, cut, -1), state, step, lambda acc: acc["out"])
