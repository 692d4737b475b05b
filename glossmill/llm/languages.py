"""Telling languages apart: by script, and by profiles of three letters where the script is Latin.

The profiles are trained when the module is first used, from the words and sentences
below. A batch of texts is scored in one vectorised pass: each run of three letters,
a word's borders being letters too, adds what it says for each language.
"""

from __future__ import annotations

import re
import sys
from functools import cache

import numpy as np

# Frequent words of each language, and the first article of the Universal Declaration of Human Rights.
TEXTS = {
    "en": """
        the a an of to and in is are was were be been it its this that these those he she they we you i my your his her our their not no but or
        if then than as at by for from with about into over after before between under out up down so who what which when where why how all any
        each more most other some such only own same very can will just should would could do does did have has had there here because while
        during through against again once both few many much every another first also where whose
        all human beings are born free and equal in dignity and rights they are endowed with reason and conscience and should act towards one
        another in a spirit of brotherhood everyone is entitled to all the rights and freedoms set forth in this declaration without distinction
        of any kind such as race colour sex language religion political or other opinion national or social origin property birth or other status
        everyone has the right to life liberty and security of person
        """,
    "fr": """
        le la les un une des du de d l à au aux et ou où mais donc car ne pas que qui quoi dont quand comment pourquoi il elle on nous vous ils
        elles je tu se s son sa ses leur leurs mon ma mes ton ta votre notre ce cet cette ces est sont était étaient été être fut a ont avait avoir
        fait dans sur sous par pour avec sans entre vers chez depuis plus moins très aussi encore même tout tous toute toutes comme si n c qu y en
        quel quelle combien voici cela alors après avant peut près
        tous les êtres humains naissent libres et égaux en dignité et en droits ils sont doués de raison et de conscience et doivent agir les uns
        envers les autres dans un esprit de fraternité chacun peut se prévaloir de tous les droits et de toutes les libertés proclamés dans la
        présente déclaration sans distinction aucune notamment de race de couleur de sexe de langue de religion d'opinion politique ou de toute
        autre opinion d'origine nationale ou sociale de fortune de naissance ou de toute autre situation
        tout individu a droit à la vie à la liberté et à la sûreté de sa personne
        """,
    "es": """
        el la los las un una unos unas de del a al y o pero no que quien quién qué cuál cómo cuándo dónde porque por para con sin sobre entre
        desde hasta hacia según en es son era eran fue fueron ser está están estaba ha han había haber hay se su sus lo le les me te nos mi tu
        este esta estos estas ese esa eso aquel más menos muy también ya todo toda todos todas cada otro otra cuando donde como si sí él ella
        ellos ellas yo cuánto cuántos cuántas durante puede tiene hace
        todos los seres humanos nacen libres e iguales en dignidad y derechos y dotados como están de razón y conciencia deben comportarse
        fraternalmente los unos con los otros toda persona tiene todos los derechos y libertades proclamados en esta declaración sin distinción
        alguna de raza color sexo idioma religión opinión política o de cualquier otra índole origen nacional o social posición económica
        nacimiento o cualquier otra condición todo individuo tiene derecho a la vida a la libertad y a la seguridad de su persona
        """,
    "de": """
        der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine in im an am auf aus bei mit nach von vom vor zu
        zum zur über unter um durch für gegen ohne bis seit ist sind war waren wird werden wurde sein hat haben hatte ich du er sie es wir ihr
        sich man mein dein ihre dieser diese dieses was wer wie wo wann warum welche welcher wenn weil dass denn als auch noch nur schon sehr
        mehr so dann hier dort kann muss soll jeder alle viele heute zwischen
        alle menschen sind frei und gleich an würde und rechten geboren sie sind mit vernunft und gewissen begabt und sollen einander im geist
        der brüderlichkeit begegnen jeder hat anspruch auf die in dieser erklärung verkündeten rechte und freiheiten ohne irgendeinen
        unterschied etwa nach rasse hautfarbe geschlecht sprache religion politischer oder sonstiger überzeugung nationaler oder sozialer
        herkunft vermögen geburt oder sonstigem stand jeder hat das recht auf leben freiheit und sicherheit der person
        """,
    "it": """
        il lo la i gli le un uno una di del dello della dei degli delle a al alla ai alle da dal dalla in nel nella nei con su sul sulla per tra
        fra e o ma non che chi cui quale come quando dove perché è sono era erano fu essere stato ha hanno aveva si suo sua suoi loro mi ti ci
        questo questa questi quello quella più meno molto anche ancora ogni tutto tutti dopo prima senza io lui lei noi gli può
        tutti gli esseri umani nascono liberi ed eguali in dignità e diritti essi sono dotati di ragione e di coscienza e devono agire gli uni
        verso gli altri in spirito di fratellanza ad ogni individuo spettano tutti i diritti e tutte le libertà enunciate nella presente
        dichiarazione senza distinzione alcuna ogni individuo ha diritto alla vita alla libertà ed alla sicurezza della propria persona
        """,
    "pt": """
        o a os as um uma uns umas de do da dos das ao à em no na nos nas por pelo pela para com sem sobre entre até e ou mas não que quem qual
        como quando onde porque é são era eram foi foram ser está estão tem têm tinha há se seu sua seus suas ele ela eles elas eu nós você me te
        lhe este esta isto esse essa isso aquele mais menos muito também já todo toda todos todas cada outro outra depois antes
        todos os seres humanos nascem livres e iguais em dignidade e em direitos dotados de razão e de consciência devem agir uns para com os
        outros em espírito de fraternidade todos os seres humanos podem invocar os direitos e as liberdades proclamados na presente declaração
        sem distinção alguma todo o indivíduo tem direito à vida à liberdade e à segurança pessoal
        """,
    "nl": """
        de het een en of maar niet geen van in op aan bij met naar voor door over onder uit tot om te is zijn was waren wordt worden werd heeft
        hebben had ik jij hij zij wij jullie ze we je mijn jouw haar hun ons dit dat deze die wat wie waar wanneer waarom hoe welke als dan ook
        nog al meer zeer heel alle elke veel er zich omdat tussen na tegen zonder
        alle mensen worden vrij en gelijk in waardigheid en rechten geboren zij zijn begiftigd met verstand en geweten en behoren zich jegens
        elkander in een geest van broederschap te gedragen een ieder heeft aanspraak op alle rechten en vrijheden in deze verklaring opgesomd
        zonder enig onderscheid een ieder heeft het recht op leven vrijheid en onschendbaarheid van zijn persoon
        """,
    "sv": """
        den det en ett och eller men inte av i på vid med till från för om under över genom efter är var vara blir har hade jag du han hon vi ni
        de dem sig min din hans hennes deras denna detta dessa som vad vem var när varför hur vilken där här också än mer mycket alla varje många
        att så utan mellan
        alla människor är födda fria och lika i värde och rättigheter de är utrustade med förnuft och samvete och bör handla gentemot varandra
        i en anda av broderskap envar är berättigad till alla de fri och rättigheter som uttalas i denna förklaring utan åtskillnad av något slag
        envar har rätt till liv frihet och personlig säkerhet
        """,
    "pl": """
        i w na z do od o po za przez dla bez nad pod przed przy między a ale lub albo nie tak jest są był była było były być ma mają się ja ty on
        ona ono my wy oni jego jej ich mój twój ten ta to te tym tego co kto gdzie kiedy dlaczego jak który która które że żeby aby jeśli już
        także też tylko bardzo więcej każdy wszystkie
        wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować
        wobec innych w duchu braterstwa każdy człowiek posiada wszystkie prawa i wolności zawarte w niniejszej deklaracji bez względu na różnice
        każdy człowiek ma prawo do życia wolności i bezpieczeństwa swej osoby
        """,
    "tr": """
        bir bu şu o ve veya ama değil ile için gibi kadar sonra önce daha çok en her bütün tüm ne kim nerede ne zaman neden nasıl hangi ki de da
        mi mı ben sen biz siz onlar var yok olan olarak oldu olur ise göre arasında üzerinde tarafından
        bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile
        hareket etmelidirler herkes bu beyannamede ilan olunan tekmil haklardan ve bütün hürriyetlerden istifade edebilir yaşamak hürriyet ve
        kişi emniyeti her ferdin hakkıdır
        """,
}
LANGUAGES = tuple(TEXTS)
#: Letters of other scripts, by the ends of their blocks.
SCRIPTS = {
    "el": ((0x370, 0x3FF),), "ru": ((0x400, 0x52F),), "he": ((0x590, 0x5FF),), "ar": ((0x600, 0x77F),), "hi": ((0x900, 0x97F),), "th": ((0xE00, 0xE7F),),
    "ja": ((0x3040, 0x30FF),), "ko": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)), "zh": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}
ALL = (*LANGUAGES, *SCRIPTS)
#: Frequent words count so many times as sentences do; what is added to each count; what a letter of another script adds.
TIMES, ADDED, WIDE = 3, 0.3, 3.0
#: What a frequent word adds to its languages together, in short texts.
KNOWN = 9.0
#: How far a question's language must lead the answer's, and an answer's the question's: in all, and for each run of letters.
SHOWN, LEAD, LEAD_EACH = 4.0, 15.0, 0.28
_WORD = re.compile(r"[^\W\d_]+")
_LATIN = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüœßąćęłńśźżğışı"
_BASE = 6


@cache
def _places() -> np.ndarray:
    """The number of each Latin letter up to U+017F, 0 for what separates words."""
    places = np.zeros(0x110000, np.uint32)
    for n, c in enumerate(dict.fromkeys(_LATIN), 1):
        places[ord(c)] = min(n, (1 << _BASE) - 1)
    return places


def _runs(text: str) -> np.ndarray:
    """The number of the three letters that begin at each place of a lower-case text; 0 in the middle makes it 0."""
    at = _places()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    runs = np.zeros(len(at), np.uint32)
    if len(at) > 2:
        runs[:-2] = (at[:-2] << 2 * _BASE | at[1:-1] << _BASE | at[2:]) * (at[1:-1] > 0)
    return runs


def _profiles() -> np.ndarray:
    """What each run of three letters says for each language; trained once a worker."""
    kept = sys.modules.setdefault("_glossmill_profiles", type(sys)("_glossmill_profiles"))
    if not hasattr(kept, "table"):
        counts = np.zeros((1 << 3 * _BASE, len(LANGUAGES)), np.float64)
        for n, text in enumerate(TEXTS.values()):
            words, sentences = _parts(text)
            for part, times in ((words, TIMES), (sentences, 1)):
                runs = _runs(f" {' '.join(part.split())} ")
                counts[:, n] += times * np.bincount(runs, minlength=len(counts))
        counts[0] = 0
        share = (counts + ADDED) / (counts + ADDED).sum(0)
        table = np.log(share)
        table -= table.mean(1, keepdims=True)
        table[counts.sum(1) == 0] = 0
        kept.table = table.astype(np.float32)
    return kept.table


def _parts(text: str) -> tuple[str, str]:
    """The frequent words and the sentences of a text of TEXTS."""
    starts = ("all human", "tous les êtres", "todos los seres", "alle menschen", "tutti gli esseri", "todos os seres", "alle mensen", "alla människor", "wszyscy ludzie", "bütün insanlar")
    start = next(at for s in starts if (at := text.find("\n        " + s)) >= 0)
    return text[:start], text[start:]


@cache
def _words() -> dict[str, list[tuple[int, float]]]:
    """The languages of each frequent word, by number, and what it adds to them."""
    of: dict[str, list[int]] = {}
    for n, text in enumerate(TEXTS.values()):
        for word in dict.fromkeys(_parts(text)[0].split()):
            of.setdefault(word, []).append(n)
    return {word: [(n, KNOWN / len(found)) for n in found] for word, found in of.items()}


def scores(texts: list[str], *, words: bool = False) -> np.ndarray:
    """A row for each text: what its letters say for each of ALL, and last the number of its runs of Latin letters.

    words: frequent words count too, as short texts have few letters.
    """
    joined = "".join(f" {t} \n" for t in (x.lower().replace("\n", " ") for x in texts))
    sizes = np.fromiter((len(t) for t in joined.split("\n")[:-1]), np.int64, len(texts)) + 1
    found = np.zeros((len(texts), len(ALL) + 1), np.float32)
    if not texts:
        return found
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    runs = _runs(joined)
    found[:, : len(LANGUAGES)] = np.add.reduceat(_profiles()[runs], starts)
    found[:, -1] = np.add.reduceat((runs > 0).astype(np.float32), starts)
    if words:
        known = _words()
        for row, text in zip(found, texts, strict=True):
            for word in _WORD.findall(text.lower()):
                for n, adds in known.get(word, ()):
                    row[n] += adds
    if not joined.isascii():
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if (codes >= 0x370).any():
            for n, blocks in enumerate(SCRIPTS.values(), len(LANGUAGES)):
                inside = np.zeros(len(codes), np.float32)
                for low, high in blocks:
                    inside[(codes >= low) & (codes <= high)] = WIDE
                found[:, n] = np.add.reduceat(inside, starts)
    return found


def differ(asked: np.ndarray, said: np.ndarray) -> np.ndarray:
    """Whether questions and answers, by their scores(), show their languages and these aren't the same.

    The question's language must lead there, and the answer's in the answer, clearly.
    Questions are scored with words. Short texts and texts of names and figures show no language.
    """
    rows = np.arange(len(asked))
    own, other = asked[:, :-1].argmax(1), said[:, :-1].argmax(1)
    shown = asked[rows, own] - asked[rows, other] >= SHOWN
    lead = said[rows, other] - said[rows, own]
    return shown & (own != other) & (lead >= np.maximum(LEAD, LEAD_EACH * said[:, -1]))
