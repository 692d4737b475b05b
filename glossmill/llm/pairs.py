"""Problem 3: question and answer pairs whose answer is unusable, by kind of defect.

A pass over Arrow batches judges each pair by itself: emptiness, copies of the
question, refusals, another language, and how the answer ends. An end is sound, or
broken for sure (a bracket, a fence, a table row or a clause left open), or in doubt.
What is in doubt is settled by all answers together:

* Answers are sorted by text. One whose beginning is all of its text, but for the
  marks at its end, of the next in order is a shortened version of that; so is one
  that ends in a stop where the longer one goes on with the same sentence.
* A single sentence without a stop is sorted in among the complete sentences of all
  answers: a common prefix with its neighbour shows how texts that begin so end.
* Lengths that far more answers have than those around are limits they were cut at.

Without such evidence a text in doubt is sound. Hints of the records (status,
truncated) aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import starmap

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm import languages
from glossmill.session import cut

#: Answers from which the cut points of the sorted order are taken, and the characters read of each.
SAMPLE, SAMPLE_CHARS = 4096, 2000
#: A length is a limit where at least so many answers have it, and so many times its neighbours' mean.
SPIKE_LEAST, SPIKE_TIMES, SPIKE_NEAR = 25, 6.0, 8

#: Characters that a sentence in doubt has to share with a complete one next to it in the sorted order; of wide scripts fewer.
BEGUN, BEGUN_WIDE = 7, 3
#: Tasks that the rows of one key are dealt to in joins with evidence; beginnings of sentences are broadcast up to so many rows.
SALTS, BROADCAST_ROWS = 8, 100_000

DEFECTS = ("empty", "copies_question", "refusal", "other_language", "truncated")

# How refusals, courtesies beside them, citations and ends of answers are written.
CITATION = re.compile(r"\s*\[S\d+(?:\s*,\s*S\d+)*\]")
OPEN_CITATION = re.compile(r"\[(?:S\d*(?:\s*,\s*S?\d*)*)?$")
ABLE = r"(?:can(?:no|')?t|can not|could not|couldn't|won't|will not|would not|wouldn't|must not|may not|(?:am|are|'m|'re) (?:not able|unable|not allowed|not permitted|not in a position|not authori[sz]ed|not willing|not comfortable|forbidden)(?: to)?|(?:have|need) to (?:decline|refuse)|must (?:decline|refuse)|decline|refuse|do not want to|don't want to)"
HELP = r"(?:answer|discuss|help(?! (?:but|\w+ing))|provide|assist|comply|give|go into|talk|support|respond|share|do (?:that|this|so)|continue|offer|this|that|your request|engage|fulfil|explain|address|say|write|reply|speak|tell|comment)"
REFUSALS = [
    rf"\b(?:i|we|i'm|we're|this assistant|the assistant)\b ?(?:(?:really|simply|just|also|still|therefore|sadly|am afraid) )?{ABLE} ?(?:to )?(?:\w+ly )?{HELP}",
    rf"^(?:(?:sorry|unfortunately|no),? )?(?:but )?(?:can't|cannot|can not|unable to|not able to|won't) (?:\w+ly )?{HELP}",
    rf"\b(?:not possible|not allowed|no way|impossible) for (?:me|us) to\b|\b(?:it is|it's) not (?:possible|permitted|allowed) to {HELP}",
    r"\b(?:i|we) (?:must|have to|need to) (?:decline|refuse)\b|\bno answer is possible\b|\bhas nothing on this\b|\b(?:i|we) (?:do not|don't) (?:have|know) (?:an answer|the answer|enough information|access)\b|\bas an ai\b.*\b(?:cannot|can't|not)\b",
    r"\b(?:do not|don't|does not|doesn't|not) (?:let|allow|permit) me (?:to )?(?:answer|discuss|help|say|give|provide|talk|share|respond|comply|do)\b|\bnot (?:something|a (?:topic|subject|question|matter)) (?:that )?(?:i|we)(?:'m| am|'re| are)? (?:can|may|able to|allowed to|could|will|comfortable|willing|prepared)\b",
    r"\b(?:i|we) (?:prefer|would prefer|would rather|'d rather|'d prefer) not\b|\b(?:i|we)(?:'d| would) (?:prefer|rather|like) (?:to )?(?:leave|skip|pass on|avoid)\b|\b(?:i|we)(?:'ll| will)? have to pass on\b|\bno comment\b|\bi'd (?:rather|prefer) not\b",
    r"\b(?:falls|is|lies|goes)? ?(?:outside|beyond) (?:of )?(?:what i (?:can|may)|(?:my|our) (?:scope|remit|abilit(?:y|ies)|capabilit(?:y|ies)|competence|permissions))\b|\bagainst (?:my|our|the) (?:rules|guidelines|policy|policies)\b|\b(?:i|we)(?:'m| am|'re| are) not (?:the right|going to)\b[^.]*\b(?:answer|discuss|help|provide)\b",
    r"\bje (?:ne )?(?:peux|puis|suis|sais|veux|dois|vais|souhaite)\b[^.]*\b(?:pas|refuser|décliner)\b|\bje (?:dois|suis obligée?) (?:de )?(?:refuser|décliner)|\bil m'est impossible\b|\bje refuse\b|\bne suis pas en mesure\b|\baucune réponse n'est possible\b|\bje n'ai pas (?:accès|le droit|la réponse)\b|\bpas autorisée? à\b",
    r"\bno (?:puedo|me es posible|estoy autorizad[oa]|estoy en condiciones|me está permitido|voy a|debo|quiero) ?(?:a |de )?(?:responder|contestar|ayudar|dar|hablar|tratar|proporcionar|ofrecer|cumplir|entrar|discutir|hacer)?|\btengo que rechazar\b|\bdebo (?:rechazar|negarme)\b|\bme niego\b|\bno es posible (?:responder|contestar|dar)\b|\bme es imposible\b|\bno tengo (?:acceso|permiso)\b",
    r"\b(?:ich (?:kann|darf|möchte|werde|will)|(?:kann|darf|möchte|werde|will) ich) (?:[\wäöüß]+ ){0,6}(?:nicht|keine?n?)\b[^.]*|\bmuss (?:ich )?[^.]*\bablehnen\b|\bkeine auskunft\b|\bnicht (?:möglich|erlaubt|gestattet)\b[^.]*|\bnicht in der lage\b|\bdabei darf ich nicht\b|\bich weigere\b|\bich lehne [^.]* ab\b",
    r"无法(?:回答|提供|帮助|讨论)|不能(?:回答|提供|帮助|讨论)|拒绝(?:回答|提供)|抱歉.*(?:无法|不能)",
]
REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS))
COURTESIES = [
    r"(?:please )?(?:ask|speak to|talk to|consult) (?:your|a|the) (?:teacher|tutor|parent|librarian|adult)\b.*",
    r"(?:please )?try (?:another|a different|again|asking)\b.*|is there anything else\b.*|(?:can|may) i help (?:you )?with (?:anything|something) else\b.*|let's (?:get back|return|go back|move on)\b.*|what else\b.*|how else\b.*",
    r"(?:i'm |i am |so |very )*(?:sorry|apologi[sz]e)\b.{0,12}|(?:my )?apologies|unfortunately|thank you|thanks(?: for (?:asking|your question|understanding))?|hmm+|oh|well|hello|hi|i understand|good question|great question",
    r"demande(?:z)? à (?:ton|ta|votre|un)\b.*|essaie(?:z)? (?:une autre|autre)\b.*|pose(?:z)? (?:une|moi une) autre\b.*|(?:je suis )?(?:vraiment |sincèrement )?désolée?|pardon|excuse(?:z)?-moi|malheureusement|je regrette|merci.*|(?:y a-t-il|as-tu|avez-vous)\b.*\bautre\b.*|revenons\b.*",
    r"pregunta(?:le)? a (?:tu|su|un)\b.*|intenta (?:otra|con otra)\b.*|prueba (?:otra|con otra)\b.*|haz otra\b.*|lo siento|lamento\b.{0,10}|por desgracia|desgraciadamente|lamentablemente|perdón|perdona|perdone|disculpa|disculpe|gracias.*|¿?hay algo más\b.*|¿?algo más\b.*|volvamos\b.*",
    r"frag(?:e|en sie)? (?:bitte )?(?:deine?n?|ihre?n?|eine?n?)\b.*|bitte frag\b.*|versuch(?:e|en sie)? (?:es )?(?:bitte )?(?:eine andere|mit einer)\b.*|stell(?:e)? (?:bitte )?eine andere\b.*|(?:es )?tut mir (?:sehr )?leid|leider(?: ist es so)?|entschuldigung|danke.*|gibt es (?:noch|sonst)\b.*|kann ich (?:dir |ihnen )?sonst\b.*|zurück zu\b.*|lass uns\b.*",
]
COURTESY = re.compile("|".join(f"(?:{p})" for p in COURTESIES))
ANSWERS_ANYWAY = re.compile(r"\b(?:however\b|but (?:here|i can(?!'t|not)|(?!(?:i|we|it|that|this|there)\b)\w+ (?:matter|are|is|can|will))\b(?!'t| not)|instead\b|mais (?:voici|je peux)\b|pero (?:aquí|puedo)\b|aber hier\b)")
ASKS_FOR = re.compile(
    r"\b(?:in|into|to|auf|ins?|en|al|a|au|vers l[ea']) ?(?:english|french|spanish|german|chinese|italian|latin|englisch|französisch|spanisch|deutsch|chinesisch|anglais|français|espagnol|allemand|chinois|inglés|francés|español|alemán|chino)\b"
    r"|\btranslat|\btradui|\btraduc|\bübersetz|翻译|用(?:英|法|德|西班牙|中)"
)
EMOJI = "\U0001f000-\U0001faff☀-➿️‍"
TRAILERS = re.compile(rf"(?:[\s*_~{EMOJI}\"'”’»)\]​]|\[S\d+(?:\s*,\s*S\d+)*\])+$")
SENTENCE = re.compile(r"(?<=[.!?。！？:])\s+|\n+|(?<=[。！？])")
WORD = re.compile(r"[^\W_]+")
AMOUNT = re.compile(r"^(?:\S+ ){0,2}?[-+−±≈~$€£]?\d[\d.,/ ]*(?:\s?[^\W\d_%°]{1,14}|\s?%|\s?°\w?)?$")
BEGINS_SENTENCE = {
    *"the a an its each two most because when if in by to around later records students unlike it this that these those he she they we you i there and or of for with".split(),
    *"le la les un une il elle on en au à de des du selon près dans pour el los las una al por se según cerca desde".split(),
    *"der die das ein eine es man im in bei nach um wenn deshalb anfangs".split(),
}
#: Words that don't end a sentence.
GOES_ON = BEGINS_SENTENCE - set("it this that these those he she they we you i there one two to in by on".split()) | set("is are was were of from with than which whose porque que como con car parce mais avec weil dass denn mit von".split())
YES_NO = {"yes", "no", "oui", "non", "sí", "si", "ja", "nein", "是", "不是", "true", "false", "maybe"}


#: Words that a refusal has one of, to look no further at other sentences.
HINTS = re.compile(r"n't|not\b|\bno\b|unable|declin|refus|able|outside|beyond|against|nothing|rather|prefer|pass on|as an ai|impossible|pas\b|refuser|décliner|aucune|rechaz|niego|negar|imposible|nicht|kein|ablehn|weigere|lehne|无法|不能|拒绝|抱歉")


def newest(turns: DataFrame) -> DataFrame:
    """(turn_id, input_text, answer_text) as logged last, once a turn; rows without a turn_id aren't turns."""
    last = F.max_by(F.struct("input_text", "answer_text"), F.struct("logged_at", "answer_text", "input_text"))
    return turns.filter("turn_id IS NOT NULL").groupBy("turn_id").agg(last.alias("t")).select("turn_id", "t.*")


def _in_order(texts: DataFrame, *, text: str) -> DataFrame:
    """texts with before and after: the nearest rows of the sorted order that are whole (a column), null at its ends.

    The order is cut into buckets at points of a bounded sample, so that the sorting
    has no single task; the first and last whole text of each bucket, a table as small
    as the number of buckets, are the neighbours of rows at its ends.
    """
    buckets = max(2, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sample = [r.t for r in texts.select(F.substring(text, 1, SAMPLE_CHARS).alias("t"), F.xxhash64(text).alias("h")).orderBy("h", "t").limit(SAMPLE).collect()]
    sample.sort(key=lambda t: t.encode())
    points = sorted({sample[n * len(sample) // buckets] for n in range(1, buckets)}, key=lambda t: t.encode()) if sample else []
    bounds = F.array(*map(F.lit, points)) if points else F.array().cast("array<string>")
    placed = texts.withColumn("bucket", F.size(F.filter(bounds, lambda p: p <= F.col(text))))
    own = F.when(F.col("whole"), F.col(text))
    ends = placed.groupBy("bucket").agg(F.min(own).alias("first"), F.max(own).alias("last"))
    passed = Window.unboundedPreceding, -1  # what follows is what was passed in the opposite order, as frames up to the end are summed anew for each row
    up, down = Window.partitionBy("bucket").orderBy(text, F.desc("whole")), Window.partitionBy("bucket").orderBy(F.desc(text), "whole")
    ends = ends.select(
        "bucket",
        F.last("last", ignorenulls=True).over(Window.orderBy("bucket").rowsBetween(*passed)).alias("last"),
        F.last("first", ignorenulls=True).over(Window.orderBy(F.desc("bucket")).rowsBetween(*passed)).alias("first"),
    )
    before = F.last(own, ignorenulls=True).over(up.rowsBetween(*passed))
    after = F.last(own, ignorenulls=True).over(down.rowsBetween(*passed))
    near = placed.withColumn("before", before).withColumn("after", after).join(ends, "bucket", "left")
    return near.withColumn("before", F.coalesce("before", "last")).withColumn("after", F.coalesce("after", "first")).drop("first", "last", "bucket")


def next_longer(answers: DataFrame, *, text: str = "answer") -> DataFrame:
    """(answer, goes_on): for each text that begins another, what follows in the one next to it in the sorted order.

    Texts are distinct. In sorted order a text that begins any other also begins the
    one right after it, so no pair is missed.
    """
    near = _in_order(answers.select(text).withColumn("whole", F.lit(True)), text=text)
    return near.filter(F.col("after").startswith(F.col(text))).select(text, F.expr(f"substring(after, length({text}) + 1, 40)").alias("goes_on"))


def begun_sentences(doubtful: DataFrame, answers: DataFrame) -> DataFrame:
    """(stem): the doubtful sentences that begin as a complete sentence next to them in the sorted order does.

    Digits count as alike. Only sentences that begin with as many characters of a doubtful one
    are sorted, as others can't have so long a common prefix with it.
    """
    shown = cut(doubtful.select("stem", _masked("stem").alias("masked")).distinct())
    least = F.when(F.substring("stem", 1, BEGUN_WIDE).rlike("[⺀-鿿가-힯]"), BEGUN_WIDE).otherwise(BEGUN)
    start = F.expr("left(stem, least)")
    stems = shown.select(F.col("masked").alias("stem")).distinct().withColumn("least", least)
    heads = stems.select(start.alias("head")).distinct()
    sentences = answers.select(F.explode(F.split("stem", r"(?<=[.!?])\s+|\n+|(?<=[。！？])")).alias("s"))
    sentences = sentences.select(F.trim("s").alias("stem")).withColumn("least", least)
    sentences = sentences.withColumn("head", _masked(start))
    if shown.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        begun = sentences.join(F.broadcast(heads), "head", "left_semi")
    else:
        begun = _known(sentences, heads, "head", "stem")
    complete = begun.filter(F.col("stem").rlike(r"[.!?。！？](?:[\"'”’»)\]* ]|\[S[^\]]*\])*$")).select(_masked("stem").alias("stem"))
    complete = cut(complete.distinct())
    near = _in_order(complete.withColumn("whole", F.lit(True)).unionByName(stems.select("stem").withColumn("whole", F.lit(False))), text="stem").filter("NOT whole")
    same = reduce(lambda a, b: a | b, (F.coalesce(F.col(c).startswith(start), F.lit(False)) for c in ("before", "after")))
    found = near.withColumn("least", least).filter(same).select(F.col("stem").alias("masked"))
    return _known(shown, found, "masked", "stem").select("stem")


def _masked(text):
    return F.translate(text, "123456789", "000000000")


def _known(rows: DataFrame, keys: DataFrame, on: str, salt: str = "turn_id") -> DataFrame:
    """rows with the columns of keys, where they are among these.

    A key that many rows have (a stock answer) is dealt to SALTS tasks by the rows' salt
    column; adaptive execution broadcasts the keys instead where they turn out small.
    """
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.hash(salt), F.lit(SALTS))).join(salted, [on, "salt"]).drop("salt")


def length_limits(lengths: DataFrame) -> DataFrame:
    """(n_chars): lengths (n_chars) that far more answers have than the lengths around them."""
    counts = lengths.groupBy("n_chars").agg(F.count("*").alias("n"))
    near = F.explode(F.sequence(F.col("n_chars") - SPIKE_NEAR, F.col("n_chars") + SPIKE_NEAR))
    around = counts.select(F.col("n_chars").alias("of"), "n", near.alias("n_chars")).groupBy("n_chars")
    around = around.agg(F.sum(F.when(F.col("of") == F.col("n_chars"), F.col("n"))).alias("own"), F.sum("n").alias("all"))
    mean = (F.col("all") - F.col("own")) / (2 * SPIKE_NEAR)
    return around.filter((F.col("own") >= SPIKE_LEAST) & (F.col("own") >= SPIKE_TIMES * mean)).select("n_chars")


def defects(turns: DataFrame) -> DataFrame:
    """(turn_id, defect): the turns with a defect, one row each.

    A turn logged several times counts once, as logged last. Turns with a null or
    blank question aren't looked at; a null answer is empty. Texts are read whole.
    Other columns than turn_id, input_text, answer_text and logged_at aren't read.
    """
    asked = newest(turns).filter("input_text RLIKE r'[^\\s\\x{00A0}\\x{200B}\\x{3000}]'")
    answer = F.regexp_replace(F.coalesce("answer_text", F.lit("")), r"^\s+|\s+$", "")
    kind = turns.schema["turn_id"].dataType.simpleString()
    judged = asked.select("turn_id", "input_text", answer.alias("answer")).mapInArrow(_judge, f"turn_id {kind}, defect string, doubt string, stem string, n_chars int")
    judged = cut(judged)
    doubtful = judged.filter("doubt IS NOT NULL").select("turn_id", "doubt", "stem", "n_chars")
    opened = doubtful.filter("doubt = 'open'")
    answers = judged.filter("stem <> ''").groupBy("stem", "n_chars").agg(F.lit(1).alias("one")).drop("one")
    longer = next_longer(answers.select(F.col("stem").alias("answer")).distinct())
    longer = _known(longer.withColumnRenamed("answer", "stem"), doubtful.select("stem").distinct(), "stem", "goes_on")
    # the longer text goes on, and behind a stop with the same sentence
    same_sentence = F.col("goes_on").rlike(r"^ ?[\p{Ll}\p{Nd}]")
    cut_short = _known(doubtful, longer, "stem").filter((F.col("doubt") == "open") | same_sentence)
    begun = _known(opened, begun_sentences(opened, answers), "stem")
    at_limit = _known(opened, length_limits(answers), "n_chars")
    shown = reduce(DataFrame.unionByName, (d.select("turn_id") for d in (cut_short, begun, at_limit))).distinct()
    return judged.filter("defect IS NOT NULL").select("turn_id", "defect").unionByName(shown.withColumn("defect", F.lit("truncated")))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(turn_id, defect, doubt, stem, n_chars) of (turn_id, input_text, answer): what judge() says, the answer without the marks at its end, its length."""
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            asked, said = part.column(1).to_pylist(), part.column(2).to_pylist()
            found = judge(asked, said)
            texts = [pa.array([f[n] for f in found], pa.string()) for n in (0, 1)]
            stems = pa.array([TRAILERS.sub("", a) for a in said], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *texts, stems, pa.array(map(len, said), pa.int32())], ["turn_id", "defect", "doubt", "stem", "n_chars"])


def judge(questions: list[str], answers: list[str]) -> list[tuple[str | None, str | None]]:
    """(defect, doubt) of each pair by itself.

    A doubt is what only evidence from other answers settles: `open`, the answer is one
    sentence without an end; `stop`, its last stop may not be the end of a sentence.
    """
    said = [CITATION.sub("", a).strip() for a in answers]
    other = languages.differ(languages.scores(questions, words=True), languages.scores(said)) if questions else np.zeros(0, bool)
    return list(starmap(_defect, zip(questions, answers, said, other.tolist(), strict=True)))


def _defect(question: str, answer: str, said: str, other: bool) -> tuple[str | None, str | None]:
    words = WORD.findall(said.lower())
    if not words:
        return "empty", None
    if _copies(WORD.findall(question.lower()), words):
        return "copies_question", None
    if _refuses(said):
        return "refusal", None
    if other and not ASKS_FOR.search(question.lower()):
        return "other_language", None
    end = _end(answer)
    return ("truncated", None) if end == "broken" else (None, end)


def _copies(question: list[str], answer: list[str]) -> bool:
    """Whether the answer is a lead-in of a few words and then only the question, whole or nearly whole."""
    asked = set(question)
    if not question or len(asked & set(answer)) < 0.7 * len(asked):
        return False
    for start in range(min(len(answer), 9)):
        rest = answer[start:]
        foreign = sum(w not in asked for w in rest)
        if foreign == 0 and len(rest) >= 0.7 * len(question) and len(asked & set(rest)) >= 0.7 * len(asked):
            return True
    return False


def _refuses(said: str) -> bool:
    """Whether the answer has a refusal and otherwise only courtesies; the first sentence that is neither settles it."""
    low = said.lower().replace("’", "'")
    refused = False
    for part in SENTENCE.split(low):
        asks = "?" in part[-4:] and len(part) < 90
        part = re.sub(rf"[*_~{EMOJI}]", "", part).strip(" \t.!?¿¡,;:-…\"“”'")
        if asks or not WORD.search(part):
            continue
        if HINTS.search(part) and REFUSAL.search(part) and not ANSWERS_ANYWAY.search(part):
            refused = True
        elif not COURTESY.fullmatch(part):
            return False
    return refused


def _end(answer: str) -> str | None:
    """How the answer ends: `broken`, in doubt (`open`, `stop`), or None for soundly."""
    broken, sound = "broken", None
    if OPEN_CITATION.search(answer) or answer.count("```") % 2:
        return broken
    if answer.rstrip().endswith("```"):
        return sound
    lines = [line.rstrip() for line in answer.split("\n") if line.strip()]
    last = lines[-1].strip()
    if last.startswith("|"):
        rows = [line.strip() for line in lines if line.strip().startswith("|")]
        return broken if not last.endswith("|") or len(rows) > 1 and last.count("|") != rows[0].count("|") else sound
    body = TRAILERS.sub("", last)
    if not body:
        return sound
    if re.search(r"[.!?][\"'”’»)]*$|[。！？]$", body):
        if body.endswith(("...", "…")) or re.fullmatch(r"\d+[.)]", body):  # the number of a list item that never came
            return broken
        # a stop after a figure, or after a word as short as abbreviations are, may not end the sentence
        return "stop" if body == last and re.search(r"(?:\d|\b[^\W\d_]{1,6})\.$", body) else sound
    if body.endswith("…") or re.search(r"[,;:(\[{=+*/×÷<>–—-]$", body):
        return broken
    item = re.match(r"(?:[-*•+]|\d+[.)])\s+(.*)", body)
    if item:
        others = [m.group(2) for line in lines[:-1] if (m := re.match(r"\s*([-*•+]|\d+[.)])\s+(.*)", line))]
        ended = sum(bool(re.search(r"[.!?。！？]$", TRAILERS.sub("", o))) for o in others)
        if ended * 2 > len(others):
            return broken
        words = WORD.findall(item.group(1).lower())
        return broken if len(words) > 6 or body[0].isdigit() and bool(words) and words[0] in BEGINS_SENTENCE else sound
    if re.match(r"[A-Za-z]\w{0,3}(?:\([^)]*\))? ?[=≈] ?\S", body) or re.fullmatch(r"[\d\s.,+*/×÷=()^-]*\d\)?", body) or AMOUNT.match(body):
        return sound
    words = WORD.findall(body)
    sentences = [s for s in SENTENCE.split(body) if s]
    if len(lines) == 1 and len(sentences) == 1:
        if body.lower() in YES_NO or len(words) <= 3 and words and words[0].lower() not in BEGINS_SENTENCE:
            return sound
        if words and words[-1].lower() in GOES_ON:
            return broken
        return "open"  # one sentence without a stop: the others show whether it is whole
    return broken  # sentences with stops, then one without
