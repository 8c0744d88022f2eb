"""Problem 2: defective prompt and response pairs.

Method: a suffix automaton over the prompt's words is traversed with the response's
words; the runs so matched measure how much of the response is copied, and of the
question given back. Further defects: refusal and courtesy phrases by one
Aho-Corasick automaton each, broken-off endings by a stack of delimiters and the form
of the last line, foreign answers by votes of stopwords.

Types, the first that holds: empty, echo, refusal, language, truncated.

Scale: each pair is judged on its own in Arrow batches, in time linear in its length,
without a shuffle of texts; only ids and types are made distinct.

Defined results: a null response is empty; a null prompt counts as empty text, which
rules out echo and language. Rows with a null id are dropped. Repeated rows count
once; if rows of one id differ, each defect found for it is a row. Whole texts are
judged, of any length. Empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.sources.tables import table

#: What stands where an answer is missing.
PLACEHOLDERS = frozenset(
    "null|nil|n/a|na|nan|undefined|todo|tbd|tba|fixme|xxx|placeholder|no answer|no response|not available|not applicable|none given|empty|blank|keine antwort|aucune réponse|sin respuesta|lorem ipsum|answer|response|reply|antwort|réponse|respuesta|output|result|assistant|insert answer here|your answer here|answer here|to be done|pending".split("|")
)
#: First words of a label before an answer.
LABEL = re.compile(r"^\s*(?:[*_#>`]*\s*(?:answer|response|reply|assistant|output|antwort|réponse|respuesta|a)\s*[*_`]*\s*[:：]\s*[*_`]*\s*)+", re.I)
#: Phrases with which an assistant declines, lower case, without apostrophes.
REFUSALS = """
i cannot|i can not|i cant|i could not|i am unable|im unable|we are unable|unable to answer|unable to help|unable to assist|unable to provide|unable to process
not able to answer|not able to help|not able to assist|not able to provide|wont be able|will not be able|cannot answer|cant answer|cannot help|cant help|cannot provide|cant provide|cannot assist|cannot comply|cannot comment|cannot discuss
i must decline|must decline|have to decline|i decline|respectfully refuse|i refuse|must refuse|respectfully decline|i wont|i will not
beyond my capabilities|beyond my abilities|beyond what i can|outside what i am permitted|outside my scope|not permitted|not allowed to|against my guidelines|my guidelines|my instructions|my programming|prevent me from|for policy reasons|policy prevents|violates
as a language model|as an ai|an assistant like me|im only an ai|im just an ai|i am only an ai|i am just an ai|do not have the ability|dont have the ability|no access to|do not have access|dont have access
dont feel comfortable|do not feel comfortable|not comfortable|rather not|prefer not to|inappropriate for me|not appropriate for me|would be inappropriate|no comment|stays unanswered|remains unanswered|have to leave to|leave to a qualified|leave that to|not in a position|i have to pass|i must pass
darf ich leider nicht|kann ich leider nicht|leider nicht beantworten|kann ich nicht|ich kann nicht|nicht helfen|nicht beantworten|ich darf nicht|als sprachmodell|als ki|keine auskunft|lehne ich ab|muss ich ablehnen|möchte ich nicht|bin nicht in der lage|nicht äußern|nicht äussern|keine angaben machen|bin ich nicht in der lage|es tut mir leid
je ne peux pas|je ne puis|je suis désolé|je regrette|je ne suis pas en mesure|ne peux pas répondre|je préfère ne pas|je dois refuser|je refuse|en tant que modèle|en tant qu|il mest impossible|ne suis pas autorisé|pas en mesure de|ne souhaite pas|ne veux pas
no puedo|lo siento|no me es posible|no estoy en condiciones|prefiero no|como modelo de lenguaje|como ia|debo declinar|debo rechazar|no estoy autorizado|no tengo permitido|me temo que no|no soy capaz|no deseo
""".replace("\n", "|").strip("|").split("|")
#: Courtesies around a refusal, which are no content.
COURTESIES = """
sorry|apologize|apologise|apologies|thank you for|thanks for|is there something else|is there anything else|please rephrase|consider asking|ask a librarian|consult an expert|please consult|please ask|another question|something else i can|i hope you understand|feel free to|please try|try again|let me know|please contact
bitte stellen sie|andere frage|bitte fragen|vielen dank|bitte wenden|bitte versuchen|kann ich sonst|verständnis
veuillez|autre question|merci de|merci pour|puis-je vous|essayez
por favor|otra pregunta|gracias por|hay algo más|consulte
that is a good question|good question|gute frage|bonne question|buena pregunta
""".replace("\n", "|").strip("|").split("|")
#: Frequent short words by language.
STOPWORDS = {
    "en": "the of and to in is was for that on with as by at from are this be it an which or were has have not but how what does why between than after under their our we such only into when while",
    "de": "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man wurde ob wenn wir diese",
    "fr": "le la les de des du et en un une est que qui dans pour pas au sur ne se ce il plus par avec son sont aux cette ou mais nous comme dont ses leur été si dès après même quelle quel comment pourquoi dit",
    "es": "el la los las de del y en un una que es por con para se no al lo como más su sus este esta entre cuando muy sin sobre ser también fue ha son pero todavía según tras si cómo qué cuál dice donde está",
    "it": "il lo gli le di del della dei delle e che è per con non una un si da nel nella sono come più anche ma questo questa dal alla ai tra quando",
    "pt": "o os as de do da dos das e que em um uma para com não se por mais como mas foi ao ele seu sua ou ser quando muito nos já também só pelo pela até isso",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als dan maar bij uit nog naar door over ze deze wordt werd",
}
#: Names of languages as they stand in a request to answer in one.
NAMES = {
    "en": "english englisch anglais inglés ingles inglese", "de": "german deutsch allemand alemán aleman tedesco", "fr": "french französisch français francais francés frances francese",
    "es": "spanish spanisch espagnol español espanol spagnolo castellano", "it": "italian italienisch italien italiano", "pt": "portuguese portugiesisch portugais portugués português", "nl": "dutch niederländisch néerlandais neerlandés",
    "ru": "russian russisch russe ruso", "el": "greek griechisch grec griego", "ja": "japanese japanisch japonais japonés", "zh": "chinese chinesisch chinois chino", "fa": "persian persisch persan persa farsi",
}
SCRIPTS = {"ru": "[а-яё]", "el": "[α-ωά-ώ]", "fa": "[؀-ۿ]", "ja": "[぀-ヿ]", "zh": "[一-鿿]"}

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_STOPS = {lang: frozenset(words.split()) for lang, words in STOPWORDS.items()}
#: Words with which no answer ends: in one language's list, and short.
_DANGLING = frozenset(
    "the a an of and or to in on with for from by at as than that which whose while when if is are was were be has have our their its this these whereas because but into between under over der die das den dem des ein eine einen einem einer und oder von zu mit auf für im am als dass wenn ob ist sind wurde wird le la les de des du un une et ou en dans pour par avec sur que qui est sont dès si el los las del un una y o con para por que es son cuando como se al lo su".split()
)
_REQUEST = {lang: re.compile(r"\b(?:in|auf|en|into|ins|em|na|по)\s+(?:the\s+)?(?:" + "|".join(names.split()) + r")\b", re.I) for lang, names in NAMES.items()}
_TERMINAL = re.compile(r"[.!?…。！？](?:[\s*_\"'”’»)\]]|\[[^\[\]]*\]|\([^()]*\))*$")
_MARKUP = re.compile(r"<[^<>]*>|&[a-z]+;|&#\d+;|[`*_#>~|\-=]+", re.I)


class SuffixAutomaton:
    """Of a sequence of words: accepts exactly its runs."""

    def __init__(self, words: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [0]
        last = 0
        for at, w in enumerate(words):
            new = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            self.end.append(at + 1)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[new] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.link.append(self.link[q])
                    self.length.append(self.length[p] + 1)
                    self.end.append(self.end[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = copy
                        p = self.link[p]
                    self.link[q] = self.link[new] = copy
            last = new

    def runs(self, words: list[str], least: int) -> list[tuple[int, int, int]]:
        """Longest matches of ``least`` words or more, none inside another: (first word
        and end in ``words``, end of an occurrence in the automaton's sequence)."""
        out: list[tuple[int, int, int]] = []
        state, size = 0, 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state, size = self.next[state][w], size + 1
            else:
                state, size = 0, 0
            if size >= least:
                run = (i + 1 - size, i + 1, self.end[state])
                if out and out[-1][0] == run[0]:
                    out[-1] = run
                else:
                    out.append(run)
        return out


def words_of(text: str) -> list[str]:
    return [m[0].lower() for m in _WORD.finditer(text)]


def question_of(prompt: str) -> str:
    """The last line of a prompt that has words; before it stand instructions and context."""
    lines = [x for x in prompt.splitlines() if _WORD.search(x)]
    last = lines[-1] if lines else ""
    return re.sub(r"^\s*(?:user question|question|q|frage|pregunta|instruction|user)\s*:\s*", "", last, flags=re.I)


def is_empty(response: str | None) -> bool:
    if response is None:
        return True
    text = "".join(c for c in response if unicodedata.category(c) not in ("Cf", "Cc") or c in "\n\t")
    text = _MARKUP.sub(" ", text)
    rest = LABEL.sub("", text.strip())
    core = rest.strip(" \t\n.:;,!?…()[]{}<>\"'/\\“”«»")
    return not _WORD.search(core) or core.lower() in PLACEHOLDERS or response.strip() == "None"


@cache
def _phrases(which: str) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p in REFUSALS if which == "refusal" else COURTESIES:
        a.add_word(f" {p} ", p)
    a.make_automaton()
    return a


def _hits(which: str, sentence: str) -> bool:
    plain = " " + " ".join(re.findall(r"[^\W_]+", sentence.lower().replace("'", "").replace("’", ""))) + " "
    return next(_phrases(which).iter(plain), None) is not None


def is_refusal(response: str) -> bool:
    """Some sentence declines and no other sentence has content."""
    declines = False
    for s in re.split(r"(?<=[.!?:])\s+|\n+", response.strip()):
        if not _WORD.search(s):
            continue
        if _hits("refusal", s):
            declines = True
        elif not _hits("courtesy", s):
            return False
    return declines


def is_echo(prompt: str, response: str) -> bool:
    """The response gives the question back, or a run of the prompt with it, and what
    it adds is at most a few words of lead."""
    # the longest sentence of the last line asks; others instruct
    line = question_of(prompt)
    q = max((words_of(x) for x in re.split(r"(?<=[.!?])\s+", line)), key=len, default=[])
    r = words_of(LABEL.sub("", response))
    if len(q) < 3 or not r:
        return False
    p = words_of(prompt)
    runs = SuffixAutomaton(p).runs(r, min(4, len(q)))
    copied = [False] * len(r)
    for a, b, _ in runs:
        copied[a:b] = [True] * (b - a)
    added = len(r) - sum(copied)
    if added > 8:
        return False
    asked = [False] * len(q)
    for a, b, _ in SuffixAutomaton(q).runs(r, min(3, len(q))):
        for x, y, _ in SuffixAutomaton(r[a:b]).runs(q, min(3, len(q))):
            asked[x:y] = [True] * (y - x)
    given = sum(asked) / len(q)
    opens = next((a for a, b, end in runs if end - (b - a) == 0), None)  # the prompt's very start is copied
    if given >= 0.8:
        # the lead and the tail may be courtesies, but a tail of content is an answer
        last = max(i for i, c in enumerate(copied) if c)
        tail = r[last + 1 :]
        return len(tail) <= 2 or _hits("courtesy", " ".join(tail)) or added <= 5 and len(r) - sum(copied) == len(tail) and _no_answer(tail)
    return opens is not None and sum(copied) >= 0.9 * len(r) and len(r) >= 8 and given < 0.8 and len(p) > len(q)


def _no_answer(tail: list[str]) -> bool:
    return not any(w in _STOPS["en"] or w.isdigit() for w in tail)


def language(text: str, least: int) -> tuple[str | None, dict[str, int]]:
    """The language with most stopwords, where it leads clearly, and all votes."""
    lower = text.lower()
    letters = sum(c.isalpha() for c in lower)
    for lang, script in SCRIPTS.items():
        if letters and len(re.findall(script, lower)) * 2 > letters:
            return lang, {lang: letters}
    ws = [w for w in re.findall(r"[^\W\d_]+", lower)]
    votes = {lang: sum(w in stops for w in ws) for lang, stops in _STOPS.items()}
    first, second = sorted(votes.values(), reverse=True)[:2]
    best = max(votes, key=lambda x: votes[x])
    return (best if first >= least and first > second else None), votes


def is_foreign(prompt: str, response: str) -> bool:
    theirs, votes = language(response, 3)
    question = question_of(prompt)
    asked, asks = language(question, 1)
    if theirs is None or asked is None or theirs == asked or votes.get(theirs, 0) < 1.5 * votes.get(asked, 0):
        return False
    if asks.get(asked, 0) < 2 and asks.get(theirs, 0):
        return False
    return not _REQUEST[theirs].search(prompt)


def is_truncated(response: str) -> bool:
    text = response.rstrip()
    if text.count("```") % 2:
        return True
    if text.endswith("```"):
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    last = lines[-1].strip()
    if last.startswith("|"):  # a table ends with a whole row
        return not last.endswith("|") or len(lines) > 1 and lines[-2].strip().startswith("|") and last.count("|") < lines[-2].count("|")
    # the stack of what is open at the end of the last line
    stack: list[str] = []
    pairs = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“"}
    for i, c in enumerate(last):
        if c in "([{«“" and not (c == "(" and i and last[i - 1] in ":;"):
            stack.append(c)
        elif c in pairs and pairs[c] in stack:
            while stack.pop() != pairs[c]:
                pass
    if stack:
        return True
    if _TERMINAL.search(text):
        return False
    if re.search(r"[,;:\-–—/&+(]$", last):
        return True
    item = re.match(r"\s*(?:[-*•]|\d+[.)])\s+", lines[-1])
    words = words_of(last)
    if words and words[-1] in _DANGLING and not last.endswith((")", "]")):
        return True
    if item:
        others = [x for x in lines[:-1] if re.match(r"\s*(?:[-*•]|\d+[.)])\s+", x)]
        stopped = sum(bool(_TERMINAL.search(x.rstrip())) for x in others)
        return bool(others) and stopped * 2 > len(others)
    if last.endswith((")", "]")) and len(words) > 3:  # a closing reference stands for the stop
        return False
    return len(words) > 3


def defect(prompt: str | None, response: str | None) -> str | None:
    if is_empty(response):
        return "empty"
    prompt = prompt or ""
    if prompt and is_echo(prompt, response):
        return "echo"
    if is_refusal(response):
        return "refusal"
    if prompt and is_foreign(prompt, response):
        return "language"
    return "truncated" if is_truncated(response) else None


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [defect(p, r) for p, r in zip(batch.column("prompt").to_pylist(), batch.column("response").to_pylist(), strict=True)]
        out = pa.record_batch([batch.column("record_table"), batch.column("record_id"), pa.array(found, pa.string())], names=["record_table", "record_id", "defect"])
        yield out.filter(pa.array([d is not None for d in found], pa.bool_()))


def defective_pairs(pairs: DataFrame) -> DataFrame:
    """(record_table, record_id, defect) of pairs (record_table, record_id, prompt,
    response) that have a defect."""
    pairs = pairs.select("record_table", "record_id", "prompt", "response").where("record_id is not null")
    return pairs.mapInArrow(_judged, "record_table string, record_id bigint, defect string").distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Defective pairs of llm_cache and notes."""
    cache_ = table(spark, folder, "llm_cache").select(F.lit("llm_cache").alias("record_table"), F.col("id").alias("record_id"), "prompt", "response")
    notes = table(spark, folder, "notes").select(F.lit("notes").alias("record_table"), F.col("id").alias("record_id"), F.col("question").alias("prompt"), F.col("answer").alias("response"))
    return defective_pairs(cache_.union(notes))


QUERIES = {"p2_found": p2_found}
SQL: dict[str, str] = {}
