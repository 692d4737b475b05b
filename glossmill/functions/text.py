"""Text functions as Spark columns; none of them leaves the JVM.

Each takes columns (or column names) and gives a column. Null in, null out, unless
a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.functions import words

Text = Column | str

LABEL_GROUP = r"\[(S\d+(?:\s*,\s*S\d+)*)\]"
CHARS_PER_TOKEN = 3.5


def col(value: Text) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strings(values) -> Column:
    return F.array(*map(F.lit, values))


def all_tokens(text: Text) -> Column:
    """Runs of letters, digits and underscores in lower case, in order, repeats kept."""
    return F.transform(F.regexp_extract_all(col(text), F.lit(r"([\p{L}\p{N}_]+)")), lambda t: F.lower(t))


def tokens(text: Text) -> Column:
    """all_tokens() without stop words."""
    return F.filter(all_tokens(text), lambda t: ~t.isin(words.STOPWORDS))


def singular(token: Column) -> Column:
    """A plain English plural made singular; up to three letters, and words in -ss, stay."""
    n = F.length(token)
    return (
        F.when(n <= 3, token)
        .when(token.endswith("ies"), F.concat(F.substring(token, F.lit(1), n - 3), F.lit("y")))
        .when(token.rlike("(ses|xes|zes|ches|shes)$"), F.substring(token, F.lit(1), n - 2))
        .when(token.endswith("s") & ~token.endswith("ss"), F.substring(token, F.lit(1), n - 1))
        .otherwise(token)
    )


def terms(text: Text) -> Column:
    """The distinct singular tokens of a text."""
    return F.array_distinct(F.transform(tokens(text), singular))


def is_superlative(token: Column) -> Column:
    """Listed comparatives and superlatives, and words of six letters or more in -est that end in none of the listed others."""
    other = f"({'|'.join(words.NOT_SUPERLATIVE)})$"
    return token.isin(words.SUPERLATIVES) | (~token.rlike(other) & (F.length(token) >= 6) & token.endswith("est"))


def modifiers(text: Text) -> Column:
    """Words of a question that only measure: superlatives, and the word after "how"."""
    measured = F.transform(F.regexp_extract_all(col(text), F.lit(rf"(?i)\bhow\s+({'|'.join(words.MEASURE_WORDS)})\b")), lambda t: F.lower(t))
    return F.array_union(F.filter(tokens(text), is_superlative), measured)


def strip_instruction(text: Text) -> Column:
    """The text without "tell me", "can you explain", "please" and, where content is left after it, a leading imperative."""
    bare = F.regexp_replace(col(text), r"(?i)\b(tell|give|show)\s+me\b|\bcan\s+you\s+(explain|describe|tell|show|give|list)\b|\bplease\b", " ")
    lead = rf"(?i)^\s*({'|'.join(words.INSTRUCTION_WORDS)})\b"
    rest = F.regexp_replace(bare, lead, "")
    return F.when(bare.rlike(lead) & (F.size(tokens(rest)) > 0), rest).otherwise(bare)


def question_terms(text: Text) -> Column:
    """Distinct tokens of a question less its instruction words and modifiers."""
    return F.array_except(F.array_distinct(tokens(strip_instruction(text))), modifiers(text))


def coverage_terms(text: Text, hint: Text) -> Column:
    """question_terms(), with those of the hint where the question has hardly any of its own or points back (it, that)."""
    own = F.array_distinct(tokens(strip_instruction(text)))
    elliptical = (F.size(F.array_except(own, strings(words.CONTINUATION_FILLERS))) <= 1) | col(text).rlike(r"(?i)\b(it|its|this|that|those|them|again)\b")
    folded = F.when(elliptical & col(hint).isNotNull(), F.array_union(own, tokens(hint))).otherwise(own)
    return F.array_except(folded, modifiers(text))


def asks_for_quantity(text: Text) -> Column:
    return col(text).rlike(r"(?i)\bhow (many|much|long|far|fast|old|tall|hot|cold|high|deep)\b|\bdegrees?\b|\bpercent\b|%|\bnumber of\b")


def role_weights(text: Text) -> Column:
    """Map of term to weight: 2.5 for the X of "of X" and "X's", 0.3 for the Y of "in Y" unless it is also an X."""
    low = lambda xs: F.array_distinct(F.transform(xs, lambda t: singular(F.lower(t))))
    entity = low(F.array_union(F.regexp_extract_all(col(text), F.lit(r"(?i)\bof\s+([a-z]+)")), F.regexp_extract_all(col(text), F.lit(r"(?i)\b([a-z]+)'s\b"))))
    unit = F.array_except(low(F.regexp_extract_all(col(text), F.lit(r"(?i)\bin\s+([a-z]+)\b"))), entity)
    weigh = lambda xs, w: F.transform(xs, lambda t: F.struct(t.alias("term"), F.lit(w).alias("weight")))
    return F.concat(weigh(entity, 2.5), weigh(unit, 0.3))


def estimate_tokens(text: Text) -> Column:
    return F.ceil(F.length(col(text)) / F.lit(CHARS_PER_TOKEN)).cast("long")


def snippet(text: Text, query: Text) -> Column:
    """Up to 200 characters from 80 before the first query word that occurs, else the text's start."""
    low = F.lower(col(text))
    found = F.filter(F.transform(F.filter(F.split(F.lower(col(query)), r"\s+"), lambda w: w != ""), lambda w: F.instr(low, w)), lambda at: at > 0)
    at = F.coalesce(F.get(found, F.lit(0)), F.lit(0))
    start = F.when(at > 0, F.greatest(at - 81, F.lit(0))).otherwise(0)
    return F.trim(F.substring(col(text), start + 1, F.lit(200)))


def labels(text: Text) -> Column:
    """Distinct citation labels by first appearance; "[S1, S3]" holds two."""
    groups = F.regexp_extract_all(col(text), F.lit(LABEL_GROUP), 1)
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"(S\d+)")))))


def figures(text: Text) -> Column:
    """Distinct numbers with sign and decimals; citation labels and a leading list number don't count."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(col(text), LABEL_GROUP, ""), r"^\s*\d+[.)](\s+|$)", ""), "−", "-")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(-?\d+(?:\.\d+)?)")))


def claimed_figures(text: Text) -> Column:
    """figures() without those in brackets right behind a number, which convert it, as in 70 °C (158 °F)."""
    converted = F.regexp_extract_all(F.regexp_replace(col(text), "−", "-"), F.lit(r"-?\d[\d,]*(?:\.\d+)?[^\s(),]*\s*\(([^()]*)\)"), 1)
    return F.array_except(figures(text), F.flatten(F.transform(converted, lambda c: F.regexp_extract_all(c, F.lit(r"(-?\d+(?:\.\d+)?)")))))


def names(text: Text) -> Column:
    """Distinct proper names: runs of capitalised words, and single ones that don't begin the text and are no month, day or I."""
    word = r"[A-Z][\p{L}'-]*(?<!['-])(?![\p{L}\p{N}_])"
    several = rf"(?<![\p{{L}}\p{{N}}_]){word}(?:\s+{word})+"
    rest = F.regexp_replace(F.regexp_replace(col(text), several, "\x01"), rf"^\s*{word}", "")
    single = F.regexp_extract_all(rest, F.lit(rf"(?<![\p{{L}}\p{{N}}_])({word})"))
    return F.array_union(F.regexp_extract_all(col(text), F.lit(f"({several})")), F.filter(single, lambda w: ~w.isin(words.NO_NAMES)))


def sentences(text: Text) -> Column:
    """Split after . ! ? before white space, and at line ends; blank parts left out."""
    return F.filter(F.split(col(text), r"(?<=[.!?])\s+|\n+"), lambda s: s.rlike(r"[^\s\x{00A0}\x{200B}\x{3000}]"))


def slug(text: Text) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", "-"), F.lit("-"))


def pointer(title: Text, text: Text) -> Column:
    """One line for a passage shown before: its title and first eight words."""
    parts = F.filter(F.split(col(text), r"\s+"), lambda w: w != "")
    dots = F.when(F.size(parts) > 8, F.lit("…")).otherwise("")
    return F.trim(F.concat(F.lit("(already shown above) "), F.coalesce(col(title), F.lit("")), F.lit(" — "), F.array_join(F.slice(parts, 1, 8), " "), dots))


def without_scripts(text: Text) -> Column:
    return F.regexp_replace(col(text), r"(?is)<script\b[^>]*>.*?</script\s*>", "")


def reply_class(text: Text) -> Column:
    """yes, no or null, for an answer to a question that asks for either."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))
    return F.when(clean.isin(words.YES_REPLIES), "yes").when(clean.isin(words.NO_REPLIES), "no")


def message_class(text: Text, blocked: list[str] | None = None) -> Column:
    """decline if it holds a blocked phrase, digits read as the letters they imitate; chat if only chatter; else normal."""
    plain = F.translate(F.lower(col(text)), "013457$@", "oieastsa")
    bare = F.regexp_replace(plain, r"[^a-z\s']", " ")
    for phrase, word in (("thank you", "thankyou"), ("got it", "gotit"), ("i see", "isee")):
        bare = F.regexp_replace(bare, phrase, word)
    said = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    chat = (F.size(said) > 0) & (F.size(F.array_except(said, strings(words.CHAT_WORDS))) == 0)
    verdict = F.when(chat, "chat").otherwise("normal")
    if blocked:
        verdict = F.when(plain.rlike(rf"\b({'|'.join(blocked)})\b"), "decline").otherwise(verdict)
    return F.when(F.trim(F.coalesce(col(text), F.lit(""))) == "", "normal").otherwise(verdict)


def is_no_claim(sentence: Text) -> Column:
    """Questions, short exclamations, bare list numbers and brackets without a label claim nothing."""
    s = F.trim(col(sentence))
    return (
        (s == "")
        | s.endswith("?")
        | (s.endswith("!") & (F.size(F.regexp_extract_all(s, F.lit(r"([\p{L}\p{N}_]+)"))) <= 4))
        | s.rlike(r"^\d+[.)]\s*$")
        | (s.rlike(r"^(\[[^\[\]]*\]\s*)+$") & ~s.rlike(r"S\d+"))
    )


def passage_id(*parts: Column) -> Column:
    """The first 32 hex digits of a SHA-256 over the parts, joined by U+001F."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)
