"""Problem 7: template residue, filler, error pages and notices that scripts are needed.

One pass of a multi-pattern automaton over each text finds phrases and the signs
that open placeholders; only texts with a hit are looked at further. They are read
in units (lines and sentences), as sound sentences beside a notice don't change
that it is one: a unit is residue where phrases cover most of its letters, or
where a placeholder or an unset value stands in it. Code, formulas and what stands
in quotation marks or backticks is left out first, as such texts show these things
as their subject. The work is one narrow pass; nothing is shuffled.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm import phrases

#: A unit is residue where phrases cover this share of its letters.
COVERAGE = 0.7
#: Unset values (null, undefined, None) that a unit needs to be residue.
UNSET = 2

KINDS = ("placeholder", "unset_value", "filler", "instruction", "error", "scripts")

# How placeholders are written. NAME is a field's name, also in capitals or with blanks for underscores.
NAME = r"[^\W\d_][\w.]*(?: [\w.]+){0,3}"
PLACEHOLDERS = [
    rf"\{{\{{\{{? ?{NAME} ?\|? ?\}}\}}\}}?",
    r"\$\{[A-Za-z][\w.]{1,}\}",
    r"\$\([A-Za-z][\w.]{1,}\)",
    rf"<%=? ?{NAME} ?%>",
    rf"#\{{{NAME}\}}",
    rf"<<{NAME}>>",
    rf"@@{NAME}@@",
    rf"\[\[{NAME}\]\]",
    r"(?i:\[insert [^\]\n]{1,60}\])",
    r"(?i:\[your [^\]\n]{1,60} here\])",
    r"(?i:\[[^\]\n]{1,60} tbd\])",
    r"(?i:\[(?:todo|tbd|tba|fixme|placeholder)\b[^\]\n]{0,80}\])",
    r"(?<![\w\\}^])(?<!\$)\{[A-Za-z][A-Za-z]+(?:[_. ][A-Za-z0-9]+)*\}(?!\$)",
    r"(?<![\w%])%[A-Za-z][A-Za-z]+(?:[_. ][A-Za-z0-9]+)*%(?![\w%])",
    r"(?<![\w~])~[A-Za-z][A-Za-z]+(?:[_. ][A-Za-z0-9]+)*~(?![\w~])",
    r"(?<![\w_])__[A-Za-z]+(?:[_. ][A-Za-z0-9]+)*__(?![\w_])",
    r"(?<![<\w])<(?!/)[A-Za-z]+(?:[_. ][A-Za-z0-9]+)*>(?!>)",
]
PLACEHOLDER = re.compile("|".join(f"(?:{p})" for p in PLACEHOLDERS))
#: Signs of which a placeholder has at least one.
SIGNS = ["{", "$(", "<", "@@", "[[", "[insert ", "[your ", " tbd]", "[todo", "[tbd", "[tba", "[fixme", "[placeholder", "%", "~", "__"]
#: Names between < and > or between __ that are markup or code.
MARKUP = set(
    "a abbr article aside audio b blockquote body br button caption center code col dd del details div dl dt em fieldset figcaption figure footer "
    "font form frame h head header hr html i iframe img input ins kbd label legend li link main mark math menu meta meter nav noscript object ol "
    "option p param path pre progress q s samp script section select small source span strong style sub summary sup svg table tbody td template "
    "textarea tfoot th thead time title tr track tt u ul var video wbr init main name str repr eq len iter next call dict doc file all".split()
) - {"title", "caption", "name", "source", "time", "label", "summary"}
#: Words of texts whose subject is markup or settings, in which bare marks such as <title> or %PATH% are named, not left over.
SUBJECT = re.compile(r"(?i)\b(?:html|xml|css|markup|tags?|elements?|attributes?|variables?|environment|windows|shell|command line|syntax|balises?|etiquetas?|umgebungsvariablen?)\b|标签|变量")
#: What happens to things in any text; in a line with other sentences it needs a phrase that follows such notices too.
COMMON = re.compile(r"\b(?:was|has been|is|were) (?:interrupted|cancelled|rejected|blocked|refused|reset|moved|removed|deleted|locked|restricted|empty|broken|unavailable|not available|not found)\b|\b(?:could not|couldn't|cannot|can't|can not) be (?:found|opened|reached|read|saved|completed|verified|shown|retrieved|established)\b|\bno longer exists?\b|\bdo(?:es)? not exist\b|\bdoesn't exist\b|\btimed out\b|\bhas expired\b")
OPENED = re.compile(r"(?:http )?(?:error|erreur|fehler|errore|erro|oops|sorry|something went wrong|00\d)\b")
UNSET_VALUE = re.compile(r"(?<![\w/-])(?:NaN|null|undefined|None(?! of\b)|NaN/NaN/NaN|\[object Object\])(?![\w/-])")
UNSET_SURE = re.compile(r"(?i)nan/nan/nan|\[object object\]")
UNIT_END = re.compile(r"\n+|(?<=[.!?])\s+|(?<=[。！？])")
CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
SHOWN = re.compile(
    r"`[^`\n]{1,200}`|“[^”\n]{1,200}”|«[^»\n]{1,200}»|„[^“”\n]{1,200}[“”]|「[^」\n]{1,200}」|《[^》\n]{1,200}》|(?<!\w)\"[^\"\n]{1,200}\"(?!\w)|(?<!\w)'[^'\n]{1,120}'(?!\w)"
)
FORMULA = re.compile(r"\$\$.+?\$\$|\$\{?[^$\n{}]{1,60}\}?\$|\\[a-zA-Z]+(?:\{[^{}\n]{0,80}\})+|(?<!\{)\{[^{}\n]{0,80}[|:=<>][^{}\n]{0,80}\}", re.S)
LETTER = re.compile(r"[^\W\d_]")
DIGIT = re.compile(r"[1-9]")
WORD = re.compile(r"[^\W\d_]+")


class Finder:
    """The automaton of all phrases and the reading of units."""

    def __init__(self):
        import ahocorasick

        lists = {"head": phrases.HEADS, "error": phrases.ERRORS, "scripts": phrases.SCRIPTS, "tail": phrases.TAILS, "instruction": phrases.WHOLE, "sure": phrases.SURE}
        roles: dict[str, set[str]] = {}
        for role, text in lists.items():
            for phrase in phrases.lines(text):
                roles.setdefault(phrase, set()).add(role)
        self.parts = ahocorasick.Automaton()
        for phrase, found in roles.items():
            self.parts.add_word(phrase, (len(phrase), frozenset(found)))
        self.parts.make_automaton()
        #: What makes a text worth a second look.
        self.first = ahocorasick.Automaton()
        look = {p for p, found in roles.items() if found - {"head", "tail"}} | set(SIGNS) | {"nan", "null", "undefined", "none"}
        repeated = phrases.lines(phrases.FILLER)
        self.latin = set(phrases.LATIN.split())
        look |= {f"{w} {w}" for w in repeated if w.isascii()} | {w for w in self.latin if len(w) > 6} | {"测试测试"}
        look = {p for p in look if "0" not in p} | {"error", "erreur", "fehler", "characters)", "code e-"}
        for phrase in look:
            self.first.add_word(phrase, len(phrase))
        self.first.make_automaton()
        self.filler = {w for phrase in repeated for w in phrase.split()}
        self.whole = set(phrases.lines(phrases.WHOLE))

    def kind(self, text: str | None) -> str | None:
        """What residue a text holds, None if none."""
        if not text:
            return None
        low = text.lower()
        if not any(_bounded(low, end + 1 - length, end + 1) for end, length in self.first.iter(low)):
            return None
        text = FORMULA.sub(_keep_placeholders, SHOWN.sub(" ", CODE.sub("\n", text)))
        for line in text.split("\n"):
            units = [u for u in (" ".join(u.split()) for u in UNIT_END.split(line)) if u]
            for unit in units:
                if kind := self.unit_kind(unit, alone=len(units) == 1):
                    return kind
        return None

    def unit_kind(self, unit: str, alone: bool = True) -> str | None:
        """The kind of residue of a line or sentence; alone: whether its line has no other."""
        if any(_is_field(m.group(), unit) for m in PLACEHOLDER.finditer(unit)):
            return "placeholder"
        if UNSET_SURE.search(unit) or len(UNSET_VALUE.findall(unit)) >= UNSET:
            return "unset_value"
        folded = _folded(unit)
        words = WORD.findall(folded)
        if len(words) >= 3:
            latin = sum(w in self.latin for w in words)
            if len(words) > 3 and latin >= 0.8 * len(words) or len(set(words)) <= len(words) // 3 + (len(words) > 4) and set(words) <= self.filler:
                return "filler"
        bare = folded.strip(" .!…:;]*-_#>\"'")
        if bare in self.whole or re.sub(r"0+", "000", bare) in self.whole:
            return _named(bare)
        return self._notice(folded, alone)

    def _notice(self, folded: str, alone: bool) -> str | None:
        """The kind of notice if one run of phrases is most of the unit, or ends it and is a whole sentence of its own."""
        spans = []
        for end, (length, roles) in self.parts.iter(folded):
            start = end + 1 - length
            if _bounded(folded, start, end + 1):
                spans.append((start, end + 1, roles))
        if not any(roles - {"head", "tail"} for _, _, roles in spans):
            return None
        if any("sure" in roles for *_, roles in spans):
            return "error"
        if not alone and COMMON.search(folded) and not OPENED.match(folded) and not any("tail" in roles for *_, roles in spans):
            return None
        letters = len(LETTER.findall(folded))
        spans.sort()
        runs: list[list] = []
        for start, stop, roles in spans:
            if runs and (start <= runs[-1][1] or not LETTER.search(folded, runs[-1][1], start)):
                runs[-1][1] = max(runs[-1][1], stop)
                runs[-1][2] |= roles
            else:
                runs.append([start, stop, set(roles)])
        for start, stop, roles in runs:
            covered = len(LETTER.findall(folded, start, stop))
            kind = "error" if "error" in roles else "scripts" if "scripts" in roles else "instruction" if "instruction" in roles else None
            if kind is None:
                continue
            ends = not LETTER.search(folded, stop)
            if kind != "instruction" and covered >= COVERAGE * letters and (kind == "error" or {"head", "tail"} & roles):
                return kind
            if ends and kind == "error" and "tail" in roles and covered >= 30:
                return kind
            if ends and "head" in roles and covered >= 20 and ("error" in roles or "scripts" in roles and "tail" in roles):
                return kind
            if ends and kind == "instruction" and covered >= 0.9 * letters:
                return kind
        return None


def _folded(text: str) -> str:
    """Lower case of the same length, digits as 0, apostrophes and blanks made alike."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    low = low.replace("\u2019", "'").replace("\xa0", " ").replace("\u202f", " ").replace("\u3000", " ")
    return DIGIT.sub("0", low)


def _keep_placeholders(match: re.Match) -> str:
    return match.group() if PLACEHOLDER.fullmatch(match.group()) else " "


def _is_field(found: str, unit: str) -> bool:
    """Whether what looks like a placeholder is one; bare marks aren't in a unit about markup or settings."""
    if found[0] in "<%~_" and not found.startswith(("<<", "<%")) and SUBJECT.search(unit):
        return False
    name = re.sub(r"[^\w. ]", "", found).strip("_ ").lower()
    if found.startswith(("<", "__")) and not found.startswith(("<<", "<%")):
        return name not in MARKUP and not re.fullmatch(r"h[1-6]", name)
    return True


def _bounded(text: str, start: int, stop: int) -> bool:
    """Whether no word of letters goes on over the ends of a phrase; scripts without blanks have no such ends."""
    return not (
        (start and text[start].isalpha() and text[start] < "⺀" and text[start - 1].isalpha() and text[start - 1] < "⺀")
        or (stop < len(text) and text[stop - 1].isalpha() and text[stop - 1] < "⺀" and text[stop].isalpha() and text[stop] < "⺀")
    )


def _named(bare: str) -> str:
    words = ("found", "forbidden", "denied", "unavailable", "error", "wrong", "request", "encontr", "introuvable", "gefunden", "fehler", "不存在", "timeout", "gateway", "unauthorized", "erreur", "errore", "refus", "deneg", "verweigert")
    return "error" if any(w in bare for w in words) else "instruction"


def finder() -> Finder:
    """The worker's finder, kept from task to task."""
    kept = sys.modules.setdefault("_glossmill_finder", type(sys)("_glossmill_finder"))
    if not hasattr(kept, "finder"):
        kept.finder = Finder()
    return kept.finder


def residue_kind(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind): each row of df, with the first kind of residue found in its text, null if none.

    Null, empty and blank texts, code, formulas and quoted phrases have none. Rows,
    null keys and repeated keys stay; other columns aren't read. Texts of any length
    are read whole.
    """
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder().kind
        for batch in batches:
            kinds = [find(value) for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string())], ["key", "kind"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, kind string").select(F.col("key").alias(key), "kind")
