"""Defective prompt and response pairs: a multi-label linear classifier that learns from defects made on purpose.

Responses of a bounded sample are cut off, copied, refused and swapped for another language; hashed n-grams and
features of the pair are learned from these, and a threshold per label is set on pairs held back. Languages are told
by hashed character n-grams, which are learned from the sample as well.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("copied", "refusal", "truncated", "language")
#: Features are hashed to so many places.
PLACES = 1 << 18
LANGUAGES = ("en", "de", "es", "fr")
#: The most common words of each language; texts of the sample that hold them teach the n-grams.
COMMON = {
    "en": "the of and to in is was that it for on with as at by from or be are were an this not had has have but which its you we he she they will would can so then than there what when how why where who do does did only a i no if",
    "de": "der die das und ist nicht ein eine einen einem den dem des zu mit auf für von im wird wurde werden nach sich auch noch war waren es man weil dass dann vom zum zur am kein keine ich sie wenn nur oder als über aus dazu darf kann wie wer warum wo",
    "es": "el la los las de del que y en un una es por con para se su al lo como más fue ha sobre entre hasta después no hay si está estaba pero cuando o porque puedo tiene esta este son han sus cómo qué cuándo dónde",
    "fr": "le la les des du de et est dans une un pour qui sur au aux ne pas il elle ce cette plus par vers sont été a on entre avec mais que en je suis à l d n qu s se leur son sa ses ou puis comment pourquoi quand où lorsque",
}
_COMMON = {k: frozenset(v.split()) for k, v in COMMON.items()}
#: How a prompt names a language; ``other`` are languages that nothing here can judge.
_NAMED = {
    "en": r"english|englisch\w*|inglés|anglais",
    "de": r"german|deutsch\w*|alemán|allemand",
    "es": r"spanish|spanisch\w*|español|castellano|espagnol",
    "fr": r"french|französisch\w*|francés|français",
    "other": r"italian|italienisch\w*|italiano|italien|portuguese|portugiesisch\w*|portugués|portugais|dutch|russian|russisch\w*|chinese|chinesisch\w*|japanese|japanisch\w*|latin|polish|turkish|arabic",
}
_ASKS = {
    k: re.compile(rf"(?:\b(?:in|into|to|auf|ins|nach|en|al|in das|vers l'|em)\s+(?:the\s+)?(?:{v})\b)|(?:\b(?:{v})\s+(?:please|bitte|por favor|answer|version|translation))", re.I) for k, v in _NAMED.items()
}
#: Every name of a language holds one of these.
_NAME_STEMS = "engl inglés angl germ deutsch alem allem span españ castellano espagnol french franz francés français ital port dutch russ chin japan latin polish turkish arabic".split()
_REPEAT = re.compile(
    r"\b(?:repeat|send (?:me )?back|echo|copy (?:out )?(?:the|this)|reproduce|return the (?:same|following) text|say (?:exactly|the following)|wiederhol\w*|gib .{0,30}(?:unverändert|wörtlich)|"
    r"schreib\w* .{0,20}ab\b|répèt\w*|répét\w*|recopi\w*|renvoie|repit\w*|repet\w*|devuelv\w*|copia (?:el|este))",
    re.I,
)
#: Every way to ask for a repetition holds one of these.
_REPEAT_STEMS = "repeat send echo copy reproduce return say wiederhol gib schreib rép recopi renvoie repit repet devuelv copia".split()
_TOKEN = re.compile(r"\w+(?:[.,]\d+)?")
_LAST_PART = re.compile(r"(?:^|\n)\s*(?:question|frage|pregunta|q)\s*:\s*(.+)\Z", re.I | re.S)
_DANGLING = re.compile(r"\n\s*(?:[-*•+]|\d{1,2}[.)]?)\s*\Z")
_ITEM = re.compile(r"^\s*(?:[-*•+]|\d{1,2}[.)])(?:\s+|$)", re.M)
_NUMBERED = re.compile(r"^\s*\d{1,2}\)", re.M)
_LETTERS = re.compile(r"[^\W\d_]+")
_SPOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?,:]")
_SENTENCE_END = re.compile(r"(?<=[.!?…。])\s+|\n+")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_WRAPPING = "*_`\"'“”«»> \n\t"

#: Refusals are put together from these: an opening, what is declined, a reason, a closing line, and whole ones.
REFUSALS = {
    "en": (
        ("", "", "Sorry, ", "I'm sorry, but ", "I am sorry, ", "Unfortunately, ", "I apologize, but ", "My apologies, ", "Regrettably, ", "I see what you are after, however ", "I'm afraid ", "Being an assistant, "),
        (
            "I cannot {do}", "I can't {do}", "I am unable to {do}", "I'm not able to {do}", "I am not permitted to {do}", "I am not allowed to {do}", "I won't be able to {do}", "I won't {do}", "I will not {do}", "I must decline to {do}",
            "I have to decline to {do}", "I would rather not {do}", "I'd rather not {do}", "I prefer not to {do}", "it is not possible for me to {do}", "I decline to {do}", "I must refuse to {do}", "I don't feel able to {do}", "there is no way for me to {do}",
        ),
        (
            "assist you here", "go along with what you ask", "give you a reply on that", "carry this out", "take this on", "produce such a text", "discuss that subject", "say anything on the matter", "assist with it", "act on this",
            "comply", "look into that for you", "deal with such questions", "offer an opinion on it", "help", "answer", "respond", "do what you ask", "provide that",
        ),
        ("", "", "", ", as my rules forbid it", ", because I lack the access that it takes", ", since it could do harm", ", because only a professional should", ", as that is outside my role", " right now", ", since I was told not to"),
        ("", "", " Is something else on your mind?", " I'd gladly take another question.", " A specialist would be the right person to ask.", " Please try elsewhere.", " Let me know what else you need."),
        (
            "That lies beyond what I am permitted to say.", "The rules I follow forbid me to reply.", "I have been told not to touch on subjects like this one.", "You will have to look elsewhere for that.", "I have to pass on this one.",
            "As an AI model I have no way to look this up.", "Being a language model, I lack access to what that would take.", "I don't have the permission that this would need.", "There will be no reply from me on that.", "Nothing can be said by me on this matter.",
            "That goes against my guidelines.", "This is not something I am willing to take part in.", "I refuse to do that.", "It is outside my remit to reply to that.", "I decline.",
        ),
    ),
    "de": (
        ("", "", "Leider ", "Es tut mir leid, aber ", "Entschuldigung, ", "Bedauerlicherweise ", "Verzeihung, ", "So leid es mir tut: "),
        ("kann ich {do}", "darf ich {do}", "ich kann {do}", "ich darf {do}", "möchte ich {do}", "ist es mir nicht möglich, {zu}", "bin ich nicht in der Lage, {zu}", "ich werde {do}"),
        ("hierbei nicht behilflich sein", "darauf nicht eingehen", "das nicht übernehmen", "so etwas nicht verfassen", "dem nicht nachkommen", "mich dazu nicht äußern", "das nicht tun", "darauf nicht antworten"),
        ("", "", ", denn meine Regeln verbieten es", ", weil mir die nötigen Rechte fehlen", ", da nur Fachkundige das sollten", ", weil es Schaden anrichten könnte"),
        ("", "", " Haben Sie ein anderes Anliegen?", " Fragen Sie bitte anderswo nach.", " Bei etwas anderem helfe ich gern."),
        ("Davon muss ich absehen.", "Das lehne ich ab.", "So etwas geht über meine Befugnisse hinaus.", "Mir wurde untersagt, darüber zu sprechen.", "Dazu werde ich nichts sagen.", "Hierfür fehlt mir die Erlaubnis."),
    ),
    "es": (
        ("", "", "Lo siento, pero ", "Lamentablemente, ", "Por desgracia, ", "Perdona, ", "Me temo que ", "Disculpe: "),
        ("no puedo {do}", "no me es posible {do}", "no tengo permiso para {do}", "no estoy autorizado a {do}", "prefiero no {do}", "debo negarme a {do}", "me resulta imposible {do}", "no podré {do}", "no voy a {do}"),
        ("hacer lo que pides", "encargarme de eso", "hablar de ese tema", "redactar algo así", "colaborar en ello", "decir nada al respecto", "contestar", "ocuparme de este asunto"),
        ("", "", ", porque mis reglas lo prohíben", ", pues me faltan los permisos", ", ya que podría causar daño", ", porque corresponde a un profesional"),
        ("", "", " ¿Necesitas alguna otra cosa?", " Busca ayuda en otra parte, por favor.", " Con gusto atiendo otra consulta."),
        ("Tengo que decir que no.", "Eso va más allá de mis atribuciones.", "Me han prohibido tratar ese tema.", "No diré nada sobre ello.", "Rechazo hacerlo.", "Me faltan los permisos para ello."),
    ),
    "fr": (
        ("", "", "Je suis désolé, mais ", "Malheureusement, ", "Désolé, ", "Navré, ", "Je crains que non : ", "Toutes mes excuses, "),
        ("je ne peux pas {do}", "je ne suis pas en mesure de {do}", "il m'est impossible de {do}", "je n'ai pas le droit de {do}", "je ne suis pas autorisé à {do}", "je préfère ne pas {do}", "je dois refuser de {do}", "je ne pourrai pas {do}", "je ne vais pas {do}"),
        ("faire ce que vous voulez", "m'occuper de cela", "parler de ce sujet", "rédiger un tel texte", "y participer", "dire quoi que ce soit là-dessus", "vous suivre sur ce point", "donner suite"),
        ("", "", ", car mes règles l'interdisent", ", faute des droits nécessaires", ", car cela pourrait nuire", ", puisque c'est l'affaire d'un professionnel"),
        ("", "", " Avez-vous besoin d'autre chose ?", " Veuillez chercher ailleurs.", " Une autre demande serait la bienvenue."),
        ("Je me vois contraint de refuser.", "Cela sort de mes attributions.", "On m'a interdit d'aborder ce sujet.", "Je n'en dirai rien.", "Je m'y refuse.", "Il me manque la permission nécessaire."),
    ),
}
_LEADS = ("", "", "", "", "You ask: ", "The question was: ", "Q: ", "Sure! ", "Your question: ", "Okay, here it is: ", "Frage: ", "Pregunta : ", "Question : ", "> ", "Of course: ", "You wrote: ")
_LEAD_WORDS = "here is this your the message task text what you asked wanted me us to know again once more so it was said as follows hier ist noch einmal deine frage esto es lo que pediste otra vez voici votre demande encore".split()
#: What may stand before a whole answer, although it speaks like a refusal.
_REMARKS = {
    "en": ("I'm sorry to say: ", "I cannot say more than this: ", "As far as I can tell, ", "I am happy to help. ", "Unfortunately for some, ", "I can't add to this: ", "In my view, "),
    "de": ("Leider muss ich sagen: ", "Mehr kann ich nicht sagen als das: ", "Soweit ich weiß: ", "Ich helfe gern. ", "Leider: "),
    "es": ("Lamento decirlo: ", "No puedo decir más que esto: ", "Que yo sepa, ", "Con gusto te ayudo. ", "Por desgracia: "),
    "fr": ("Je regrette de le dire : ", "Je ne peux pas en dire plus : ", "À ma connaissance, ", "Je vous aide volontiers. ", "Hélas : "),
}
#: Words by which one speaks of oneself.
_SELF = re.compile(r"\b(?:i|i'm|my|me|myself|ich|mir|mich|mein\w*|yo|mi|mí|puedo|tengo|debo|prefiero|estoy|siento|je|j['’]\w+|moi|mon|mes)\b")
#: First letters of other scripts' alphabets, for responses in a language that the sample does not hold.
_SCRIPTS = (0x3B1, 0x430, 0x561, 0x5D0, 0x627, 0x905, 0xE01, 0x3042, 0x4E00, 0xAC00)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def has_answer(response: str | None) -> bool:
    return bool(response) and any(c.isalnum() for c in response)


class Memo(dict):
    """Values by key, computed once; begins anew at a bounded number of keys."""

    def __init__(self, compute, most: int = 500_000) -> None:
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class Tongues:
    """Which language a text is in: naive Bayes, a linear classifier on hashed character n-grams of its words.

    It learns from texts in which common words of one language prevail, and from these words themselves. N-grams that
    it never saw speak for no language; ``strange`` is their share.
    """

    PLACES = 1 << 17
    #: Total log odds against the second language from which on a text is said to be in one.
    SURE = 3.0

    def __init__(self, texts: Iterable[str] = ()) -> None:
        counts = np.zeros((self.PLACES, len(LANGUAGES)), np.float32)
        for n, k in enumerate(LANGUAGES):
            for w in _COMMON[k]:
                np.add.at(counts[:, n], self._grams(w), 2)
        grams = Memo(self._grams)
        for text in texts:
            words = [w for w in tokens(text) if w.isalpha()]
            hits = sorted(((sum(w in _COMMON[k] for w in words), n) for n, k in enumerate(LANGUAGES)), reverse=True)
            if hits[0][0] >= 2 and hits[0][0] > 2 * hits[1][0]:
                np.add.at(counts[:, hits[0][1]], list(chain.from_iterable(grams[w] for w in words)), 1)
        self.known = counts.sum(1) > 0
        share = (counts + 0.5) / (counts.sum(0) + 0.5 * max(int(self.known.sum()), 1))
        odds = np.log(share)
        self.odds = np.where(self.known[:, None], odds - odds.mean(1, keepdims=True), 0).astype(np.float32)
        self._start()

    def _start(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.zeros((1024, len(LANGUAGES) + 2), np.float32)

    def __getstate__(self):
        return {"known": self.known, "odds": self.odds}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self._start()

    @staticmethod
    def _grams(word: str) -> list[int]:
        padded = f"<{word}>"
        return [zlib.crc32(padded[i : i + k].encode()) % Tongues.PLACES for k in (1, 2, 3, 4) for i in range(len(padded) - k + 1)] + [zlib.crc32(padded.encode(), 7) % Tongues.PLACES]

    def _id(self, word: str) -> int:
        found = self.ids.get(word)
        if found is None:
            found = self.ids[word] = len(self.ids)
            if found >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            if word.isalpha():
                grams = self._grams(word)
                odds = self.odds[grams].sum(0) / 2  # grams of a word overlap
                odds = np.clip(odds - odds.mean(), -4, 4)
                self.table[found] = [*odds, len(grams), (~self.known[grams]).sum()]
            else:
                self.table[found] = 0
        return found

    def judge(self, texts: Sequence[list[str]]) -> np.ndarray:
        """Of each list of words: the log odds of the languages, and the share of n-grams never seen."""
        if len(self.ids) > 500_000:
            self._start()
        ids = [[self._id(w) for w in words] for words in texts]
        sizes = np.array([len(x) for x in ids])
        sums = np.zeros((len(ids), len(LANGUAGES) + 2), np.float64)
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum()))
        filled = sizes > 0
        if flat.size:
            sums[filled] = np.add.reduceat(self.table[flat].astype(np.float64), (np.cumsum(sizes) - sizes)[filled])
        return np.column_stack([sums[:, : len(LANGUAGES)], sums[:, -1] / np.maximum(sums[:, -2], 1)])

    def spoken(self, odds: Sequence[float], least: float = SURE) -> str:
        """The language of such odds, or nothing where the second one comes within ``least``."""
        best, second = sorted(odds[: len(LANGUAGES)], reverse=True)[:2]
        return LANGUAGES[list(odds).index(best)] if best - second >= least else ""

    def wanted(self, prompt: str, odds: np.ndarray) -> str:
        """The language that a prompt asks for, else its own, of which ``odds`` are the log odds."""
        low = prompt.lower()
        if any(stem in low for stem in _NAME_STEMS):
            named = [k for k, p in _ASKS.items() if p.search(prompt)]
            if len(named) == 1:
                return named[0]
        return self.spoken(odds, 1.5)


def question_of(prompt: str) -> str:
    found = ":" in prompt and _LAST_PART.search(prompt)
    return found[1] if found else prompt.rsplit("\n\n", 1)[-1]


def asks_to_repeat(prompt: str) -> bool:
    low = prompt.lower()
    return any(stem in low for stem in _REPEAT_STEMS) and bool(_REPEAT.search(prompt))


def pieces_of(text: str, size: int = 4) -> list[str]:
    """A text of at most ``size`` sentences or lines as it is, a longer one in overlapping pieces of so many, so that
    what is said in one place counts as much in a long text as in a short one."""
    parts = _SENTENCE_END.split(text)
    return [text] if len(parts) <= size else [" ".join(parts[k : k + size]) for k in range(0, len(parts) - size // 2, size // 2)]


def _bin(x: float, edges: tuple[float, ...]) -> int:
    return bisect_right(edges, x)


def _rises(a: list[str], b: list[str], block: int = 16_384) -> list[int]:
    """Where in ``a`` the longest common subsequence of ``a[: k + 1]`` and ``b`` grows; so it has as many words as there
    are places. Bit-parallel, ``b`` in blocks of bounded size whose carries go on to the next one."""
    within = set(b)
    at = [k for k, w in enumerate(a) if w in within]
    carries = bytearray(len(at))
    for start in range(0, len(b), block):
        masks: dict[str, int] = {}
        bits = 0
        for w in b[start : start + block]:
            masks[w] = masks.get(w, 0) | 1 << bits
            bits += 1
        full = row = (1 << bits) - 1
        get = masks.get
        for n, k in enumerate(at):
            same, carry = get(a[k], 0), carries[n]
            if same or carry:
                total = row + (row & same) + carry
                carries[n] = total >> bits
                row = (total | (row & ~same)) & full
    return [k for n, k in enumerate(at) if carries[n]]


def _span(response: list[str], prompt: list[str], last: int) -> int:
    """Words from the first to the last (``last``) of the response that stand in the prompt in the same order."""
    return _rises(response[last::-1], prompt[::-1])[-1] + 1


def _again(response: list[str], prompt: list[str]) -> int:
    """Words of the response in runs of three that the prompt has; these may come repeatedly."""
    threes = set(zip(prompt, prompt[1:], prompt[2:]))
    found, end = 0, 0
    for k, three in enumerate(zip(response, response[1:], response[2:])):
        if three in threes:
            found += k + 3 - max(k, end)
            end = k + 3
    return found


class Asked:
    """What follows from a prompt alone: its words, its question's words, whether it asks to repeat, the language it
    wants, its first words."""

    __slots__ = ("words", "within", "question", "repeat", "want", "sign")

    def __init__(self, prompt: str, words: list[str], odds: Sequence[float], tongues: Tongues) -> None:
        self.words = words
        self.within = frozenset(self.words)
        self.question = tokens(question_of(prompt))
        self.repeat, self.want = asks_to_repeat(prompt), tongues.wanted(prompt, odds)
        self.sign = " ".join(w if w.isalpha() else re.sub(r"\d\S*", "N", w) for w in self.words[:3])


_EDGES = (0.3, 0.5, 0.65, 0.75, 0.82, 0.88, 0.94, 0.99)


def likeness(said: list[str], asked: Asked) -> tuple[int, int, int, int] | None:
    """Bins of how much of the response stands in the prompt, how much of the prompt (or its question) in the response,
    of the other words, and of the stretch of words that holds them; None where less than a half is alike either way."""
    n, common = max(len(said), 1), len([w for w in said if w in asked.within])
    if 2 * common < min(n, len(asked.words), len(asked.question)):
        return None  # no order of words could make it more
    rises = _rises(said, asked.words)
    held = len(rises)
    held_q = held if asked.question == asked.words else len(_rises(said, asked.question))
    cover = max(held / max(len(asked.words), 1), held_q / max(len(asked.question), 1))
    same = max(held, _again(said, asked.words)) if 2 * common >= n else held
    share = same / n
    if max(share, cover) < 0.5:
        return None
    span = _span(said, asked.words, rises[-1]) if rises else 0
    return _bin(share, _EDGES), _bin(cover, _EDGES), _bin(n - same, (1, 2, 3, 4, 5, 6, 8, 10, 15, 25)), _bin(span / n, _EDGES)


def _place(label: str, name: str) -> int:
    return len(LABELS) + zlib.crc32(f"{label} {name}".encode()) % (PLACES - len(LABELS))


def _copied(key: tuple) -> list[int]:
    like, repeat = key
    names = ["apart"] if like is None else [f"share {like[0]}", f"cover {like[1]}", f"both {like[0]} {like[1]}", f"extra {like[2]} {like[1]}", f"span {like[3]}", "alike"]
    return [0] + [_place("copied", f"{x} {repeat}") for x in names]


def _refusal(key: tuple) -> list[int]:
    length, sentences = key
    return [1, _place("refusal", f"length {length}"), _place("refusal", f"sentences {sentences}")]


def _truncated(key: tuple) -> list[int]:
    shown, sign, items, seen, opened, odd_quote, fence, line, dangling, structure, n = key
    names = (
        f"kind {shown}", f"kind sign {shown} {sign}", f"kind list {shown} {items}", f"seen {seen} {shown}", f"opened {max(-2, min(opened, 3))}", f"quote {odd_quote}", f"fence {fence}", f"both {shown} {opened != 0} {odd_quote}",
        f"line {line} {items} {shown}", f"dangling {dangling}", f"structure {structure} {opened > 0} {fence}", f"words {n} {shown} {sign}", f"list {items} {sign}",
    )
    return [2] + [_place("truncated", x) for x in names]


def _language(key: tuple) -> list[int]:
    want, spoken, differs, margin, n, strange, copy = key
    names = (f"pair {want} {spoken}", f"differs {differs} {margin}", f"margin {margin} {n}", f"copy {copy} {differs}", f"strange {strange} {bool(want)} {bool(spoken)}", f"strange {strange} {n}")
    return [3] + [_place("language", x) for x in names]


class Encoder:
    """Pairs as hashed features by label; place n is the constant of label n."""

    def __init__(self, tongues: Tongues, known: dict[str, int]) -> None:
        self.tongues, self.known = tongues, known
        self._start()

    def _start(self) -> None:
        self.asked: dict[str, Asked] = {}
        self.words = Memo(lambda w: zlib.crc32(w.encode()))
        self.chars = Memo(lambda name: _place("truncated", name))
        self.memos = [Memo(f) for f in (_copied, _refusal, _truncated, _language)]

    def __getstate__(self):
        return {"tongues": self.tongues, "known": self.known}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self._start()

    def ask(self, prompts: Iterable[str]) -> list[Asked]:
        """What follows from each prompt; kept for a bounded number of them."""
        prompts = list(prompts)
        if len(self.asked) > 20_000:
            self.asked.clear()
        new = [p for p in dict.fromkeys(prompts) if p not in self.asked]
        words = [tokens(p) for p in new]
        for prompt, its, odds in zip(new, words, self.tongues.judge(words).tolist()):
            self.asked[prompt] = Asked(prompt, its, odds, self.tongues)
        return [self.asked[p] for p in prompts]

    def encode(self, pairs: Sequence[tuple[str, str]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By label the places of all rows one after another, the number of places of each row, and its pair. A pair is
        one row, but for refusals, where each piece of the response is one."""
        asked = self.ask(p for p, _ in pairs)
        said = [tokens(r) for _, r in pairs]
        alike = [likeness(s, a) for s, a in zip(said, asked)]
        copied = [self.memos[0][like, a.repeat] for like, a in zip(alike, asked)]
        truncated = [self._ends(r, s, a) for (_, r), s, a in zip(pairs, said, asked)]
        language = []
        for odds, s, a, like in zip(self.tongues.judge(said).tolist(), said, asked, alike):
            n, spoken, over, differs = max(len(s), 1), "", 0.0, False
            if sum(map(str.isalpha, s)) > 1:  # one word may be a name or a unit
                spoken = self.tongues.spoken(odds)
                if a.want in LANGUAGES:
                    over = max(odds[: len(LANGUAGES)]) - odds[LANGUAGES.index(a.want)]
                    differs = over >= self.tongues.SURE
            copy = like is not None and like[0] >= 5 and like[1] >= 5
            language.append(self.memos[3][a.want, spoken, differs, _bin(over / n, (0.1, 0.3, 0.6, 1.0)), _bin(n, (4, 8, 15)), _bin(odds[-1], (0.15, 0.3, 0.45, 0.6, 0.8)), copy])

        every = np.arange(len(pairs))

        def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            sizes = np.array([len(x) for x in lists])
            return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes, every

        pieces = [pieces_of(r) for _, r in pairs]
        refusal = self._phrases(list(chain.from_iterable(pieces)))
        return [flat(copied), (*refusal, np.repeat(every, [len(x) for x in pieces])), flat(truncated), flat(language)]

    def _ends(self, response: str, said: list[str], asked: Asked) -> list[int]:
        body, n = response.strip(), len(said)
        core = body.strip(_WRAPPING)
        last = core[-1:]
        kind = "none" if not last else "stop" if last in ".!?…。" else "comma" if last in ",;:-–(/" else "close" if last in "}])" else "digit" if last.isdigit() else "letter" if last.isalpha() else "other"
        pieces = [_NUMBER.sub("N", w) for w in core.lower().split()[-4:]]
        line = core.rsplit("\n", 1)[-1]
        lines = "\n" in body
        items, fences = min(len(_ITEM.findall(body)), 6) if lines or body[:1] in "-*•+0123456789" else 0, body.count("```") % 2
        opened = sum(map(body.count, "{[(")) - sum(map(body.count, "}])"))
        if ")" in body:
            opened += len(_NUMBERED.findall(body))
        odd_quote = body.count('"') % 2
        tail = _LETTERS.findall(pieces[-1])[-1:] if pieces else []
        tail = tail or _LETTERS.findall(core.lower())[-1:] or [""]
        seen = _bin(self.known.get(tail[0], 0), (1, 2, 4, 8, 20))
        shown = kind if kind not in ("letter", "digit") or n > 3 or opened or odd_quote or lines else "short"
        key = (
            shown, asked.sign, items, seen, opened, odd_quote, fences, _bin(len(line.split()), (1, 2, 3, 4, 6, 9)), lines and bool(_DANGLING.search(body)),
            body[:1] in ("{", "[") or body[:3] == "```", _bin(n, (1, 2, 3, 4, 6, 9, 13, 20)),
        )
        chars, low = self.chars, core[-4:].lower()
        open_ended = [chars[f"final {shown} {pieces[-1] if pieces else ''}"]] + [chars[f"tail {k} {' '.join(pieces[-k:])}"] for k in (2, 3) if len(pieces) >= k] + [chars[f"chars {shown} {low[-k:]}"] for k in (1, 2, 3, 4)]
        return self.memos[2][key] + open_ended

    def _phrases(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Refusal: n-grams of one to four words and marks, once each per piece, and those that it begins with."""
        low = [_SPOKEN.findall(x.lower()) for x in pieces]
        sizes = np.array([len(x) for x in low])
        word = np.fromiter(map(self.words.__getitem__, chain.from_iterable(low)), np.uint64, int(sizes.sum())) + np.uint64(1)
        row = np.repeat(np.arange(len(low)), sizes)
        first = np.cumsum(sizes) - sizes
        found, h = [], np.zeros(len(word), np.uint64)
        factor, last = np.uint64(0x9E3779B97F4A7C15), len(word)

        def spread(x: np.ndarray, seed: int) -> np.ndarray:
            x = (x + np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            return len(LABELS) + ((x >> np.uint64(33)) % np.uint64(PLACES - len(LABELS))).astype(np.int64)

        for k in (1, 2, 3, 4):
            if last < k:
                break
            h = h[: last - k + 1] * factor + word[k - 1 :]
            rows = row[: last - k + 1]
            whole = rows == row[k - 1 :]
            found.append(rows[whole] * PLACES + spread(h[whole], k))
            begins = np.flatnonzero(sizes >= k)
            found.append(begins * PLACES + spread(h[first[begins]], 10 + k))
        common = []
        for words in low:
            stops = words.count(".") + words.count("!") + words.count("?")
            common += self.memos[1][_bin(len(words), (3, 6, 10, 15, 20, 30, 45)), _bin(stops, (1, 2, 3, 4))]
        found.append(np.repeat(np.arange(len(low)), 3) * PLACES + np.array(common))
        both = np.sort(np.concatenate(found))
        both = both[np.diff(both, prepend=-1) > 0]
        return both % PLACES, np.bincount(both // PLACES, minlength=len(low))


# --- defects made on purpose


def refuse(rng: random.Random, tongue_of: str, prompt: str) -> str:
    """A refusal to do the task, which at times is named in the prompt's own words."""
    opening, verb, act, reason, closing, whole = REFUSALS[tongue_of or "en"]
    asked = prompt.split()
    if rng.random() < 0.3:
        text = rng.choice(whole)
    elif asked and rng.random() < 0.4:
        at = rng.randrange(len(asked))
        text = rng.choice(opening) + rng.choice(verb).replace("{do}", "").replace("{zu}", "") + " ".join(asked[at : at + rng.randrange(2, 9)]).strip(".?!:;, ")
        text = text[:1].upper() + text[1:] + rng.choice(reason) + "."
    else:
        do, v = rng.choice(act), rng.choice(verb)
        said = v.replace("{do}", do).replace("{zu}", do)
        text = rng.choice(opening) + said
        text = text[:1].upper() + text[1:] + rng.choice(reason) + "."
    return text + rng.choice(closing)


def copy(rng: random.Random, prompt: str) -> str:
    text = question_of(prompt) if rng.random() < 0.4 else prompt
    how = rng.random()
    if how < 0.15:
        text = text.upper()
    elif how < 0.3:
        text = text.lower()
    elif how < 0.4:
        text = "\n".join(f"> {x}" for x in text.split("\n"))
    elif how < 0.5:
        text = re.sub(r"[^\w\s]", "", text)
    elif how < 0.6:
        text = rng.choice(('"{}"', "**{}**", "```\n{}\n```", "«{}»")).format(text)
    words = text.split(" ")
    for _ in range(rng.choice((0, 0, 0, 1, 2)) if len(words) > 9 else 0):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice(([], [words[k], rng.choice(("the", "now", "please"))], [rng.choice(("this", "that", "one"))]))
    lead = rng.choice(_LEADS) if rng.random() < 0.7 else " ".join(rng.choices(_LEAD_WORDS, k=rng.randrange(2, 7))).capitalize() + rng.choice((": ", ":\n", " - "))
    return lead + " ".join(words)


def cut_off(rng: random.Random, response: str) -> str | None:
    """The response broken off inside a word, a sentence, an item or a structure."""
    text = response.rstrip()
    if len(text.split()) < 5:
        return None
    markers = [m for m in _ITEM.finditer(text) if m.start() > 3]
    if markers and rng.random() < 0.2:
        marker = rng.choice(markers)
        return text[: rng.randrange(marker.start() + 2, marker.end() + 1)]
    for _ in range(8):
        at = rng.randrange(max(4, len(text) // 6), len(text) - 1)
        if rng.random() < 0.5:
            at = text.rfind(" ", 0, at)
        left = text[:at].rstrip() if at > 3 else ""
        if not left or left[-1] in ".!?…}]\"*`" or not any(c.isalnum() for c in left) or text[len(left) :].lstrip(" .!\"*`'»”\n")[:1] == "":
            continue
        follows = text[len(left) :]
        if _ITEM.search(text) and (follows.startswith("\n") or not left[-1].isalnum()):
            if not _DANGLING.search(left):
                continue  # whole items only: no plain break
        return left + rng.choice(("", "", "", " ", ",", ", so", ", and", ", because", " the", " (", " and"))
    return None


def foreign(rng: random.Random, text: str) -> str:
    """The text's letters in another script, as a response in a language that the sample does not hold."""
    first = rng.choice(_SCRIPTS)
    return "".join(chr(first + ord(c.lower()) % 24) if c.isalpha() else c for c in text)


def training_pairs(sample: list[tuple[str, str]], seed: int, encoder: Encoder) -> list[tuple[int, str, str, str]]:
    """(row, prompt, response, label) of a sample: each pair as it is (label "") and with defects made on purpose."""
    rng = random.Random(seed)
    by_tongue: dict[str, list[str]] = {k: [] for k in LANGUAGES}
    spoken = []
    said = [tokens(r) for _, r in sample]
    for odds, words, (_, response) in zip(encoder.tongues.judge(said).tolist(), said, sample):
        spoken.append(encoder.tongues.spoken(odds))
        if spoken[-1] and len(words) >= 6:
            by_tongue[spoken[-1]].append(response)
    made = []
    for row, ((prompt, response), asked) in enumerate(zip(sample, encoder.ask(p for p, _ in sample))):
        made.append((row, prompt, response, ""))
        want = asked.want
        speaks = rng.choice((want, want, "en"))
        made.append((row, prompt, refuse(rng, speaks if speaks in LANGUAGES else "en", prompt), "refusal"))
        if not asked.repeat:
            made.append((row, prompt, copy(rng, prompt), "copied"))
            if rng.random() < 0.3:
                made.append((row, prompt, f"{rng.choice(_LEADS)}{question_of(prompt)} {response}", ""))
            if spoken[row] and rng.random() < 0.15:
                made.append((row, prompt, rng.choice(_REMARKS[spoken[row]]) + response, ""))
        for _ in range(2):
            if broken := cut_off(rng, response):
                made.append((row, prompt, broken, "truncated"))
        if want in LANGUAGES and spoken[row] == want:
            other = [k for k in LANGUAGES if k != want and by_tongue[k]]
            for k in rng.sample(other, min(len(other), 1 if want == "en" else 2)):
                made.append((row, prompt, rng.choice(by_tongue[k]), "language"))
            if rng.random() < 0.2:
                made.append((row, prompt, foreign(rng, response), "language"))
    return made


class PairModel:
    """Weights over hashed places, one constant per label, and a threshold per label. Can be pickled and used again."""

    def __init__(self, weights: np.ndarray, thresholds: list[float], encoder: Encoder) -> None:
        self.weights, self.thresholds, self.encoder = weights, thresholds, encoder

    def scores(self, pairs: Sequence[tuple[str, str]]) -> np.ndarray:
        """Of each pair, the score of each label; of several rows of a pair the highest."""
        out = np.full((len(pairs), len(LABELS)), -np.inf)
        for start in range(0, len(pairs), 2048):
            for label, (places, sizes, owner) in enumerate(self.encoder.encode(pairs[start : start + 2048])):
                np.maximum.at(out[:, label], start + owner, np.add.reduceat(self.weights[places].astype(np.float64), np.cumsum(sizes) - sizes))
        return out

    def defects(self, pairs: Sequence[tuple[str, str | None]]) -> list[str | None]:
        """The first defect that fits each pair, or None."""
        found: list[str | None] = ["empty"] * len(pairs)
        answered = [k for k, (_, r) in enumerate(pairs) if has_answer(r)]
        if answered:
            over = self.scores([pairs[k] for k in answered]) > np.array(self.thresholds)
            first = np.where(over.any(1), over.argmax(1), len(LABELS))
            for k, label in zip(answered, first):
                found[k] = LABELS[label] if label < len(LABELS) else None
        return found

    def defect(self, prompt: str, response: str | None) -> str | None:
        return self.defects([(prompt, response)])[0]


def _fit(rows: list[list[np.ndarray]], labels: list[list[str]], epochs: int, rate: float, decay: float, seed: int) -> np.ndarray:
    """Logistic regression of every label by AdaGrad over small batches."""
    rng = np.random.default_rng(seed)
    weights, squares, sums = np.zeros(PLACES, np.float32), np.full(PLACES, 1e-6, np.float32), np.zeros(PLACES, np.float32)
    for label, name in enumerate(LABELS):
        flat = rows[label]
        target = np.array([y == name for y in labels[label]], np.float32)
        # A label says nothing about another label's defects of higher rank: these rows are left out.
        usable = np.array([k for k, y in enumerate(labels[label]) if not y or y == name or LABELS.index(y) > label or name in ("language", "refusal")])
        for _ in range(epochs * (3 if name == "refusal" else 1)):  # more turns for what is dropped at random
            rng.shuffle(usable)
            for start in range(0, len(usable), 64):
                batch = usable[start : start + 64]
                sizes = np.array([len(flat[k]) for k in batch])
                at = np.concatenate([flat[k] for k in batch])
                if name == "refusal":  # each wording has to do without the half of the others
                    stays = rng.random(len(at)) < 0.5
                    stays[np.cumsum(sizes) - sizes] = True
                    at, sizes = at[stays], np.add.reduceat(stays, np.cumsum(sizes) - sizes)
                z = np.add.reduceat(weights[at], np.cumsum(sizes) - sizes)
                error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[batch]
                np.add.at(sums, at, np.repeat(error, sizes) / len(batch))
                old = weights[at]  # a place that stands in ``at`` repeatedly is set to the same value each time
                gradient = sums[at] + decay * old
                squares[at] = moved = squares[at] + gradient * gradient
                weights[at] = old - rate * gradient / np.sqrt(moved)
                sums[at] = 0
    return weights


def _ending(response: str) -> str:
    words = _NUMBER.sub("N", response.strip(_WRAPPING).lower()).split()
    return " ".join(words[-2:])


def _refusing() -> re.Pattern:
    verbs = {v.split("{")[0].strip().lower().removeprefix("i am ").removeprefix("i'm ") for _, verb, *_ in REFUSALS.values() for v in verb}
    wholes = {" ".join(w.lower().rstrip(".").split()[:5]) for *_, whole in REFUSALS.values() for w in whole}
    return re.compile("|".join(sorted(map(re.escape, verbs | wholes), key=len, reverse=True)))


def doubtful(sample: list[tuple[str, str]], encoder: Encoder, often: int = 4) -> list[bool]:
    """Pairs of a sample that had better not stand as whole ones at first: responses that speak of themselves or have
    words of a refusal, open ends that are rare in the sample, most of the prompt over again, or another language than wanted."""
    endings = Counter(_ending(r) for _, r in sample)
    refusing = _refusing()
    out = []
    words = [tokens(r) for _, r in sample]
    for (_, response), asked, said, odds in zip(sample, encoder.ask(p for p, _ in sample), words, encoder.tongues.judge(words).tolist()):
        body = response.strip()
        core = body.strip(_WRAPPING)
        is_open = len(said) > 3 and (core[-1:] not in ".!?…})]" or body.count("```") % 2 == 1 or body.count("{") != body.count("}"))
        spoken, like = encoder.tongues.spoken(odds), likeness(said, asked)
        again = not asked.repeat and like is not None and like[0] >= 3 and like[1] >= 3
        low = response.lower()
        out.append(bool(_SELF.search(low) or refusing.search(low)) or (is_open and endings[_ending(response)] < often) or again or bool(asked.want in LANGUAGES and spoken and asked.want != spoken))
    return out


def fit(sample: list[tuple[str, str]], *, epochs: int = 3, rate: float = 0.3, decay: float = 1e-5, seed: int = 7, sure: float = 2.5) -> PairModel:
    """Learn from a sample of (prompt, response).

    The sample has defects of its own. So :func:`doubtful` pairs don't stand as whole ones at first; then the model is
    learned again on all pairs that it finds whole, doubtful or not, with scores below 0 for a refusal (of whose wording
    the first model has seen no other sort) and below ``-sure`` for the rest. A fifth of the pairs is
    held back to set each label's threshold, the score with the fewest errors there (the middle of the best stretch);
    whole pairs count four times. A label without examples to learn from is never given; so without any pair that may
    stand as whole only ``empty`` is.
    """
    sample = [(p, r) for p, r in sample if p and has_answer(r)]
    known: Counter[str] = Counter()
    for prompt, response in sample:
        words = _LETTERS.findall(response.lower())
        known.update(set(words[:-1]) | set(_LETTERS.findall(prompt.lower())))
    tongues = Tongues(chain.from_iterable(sample))
    encoder = Encoder(tongues, known)
    kept = [x for x, doubt in zip(sample, doubtful(sample, encoder)) if not doubt]
    model = PairModel(np.zeros(PLACES, np.float32), [0.0] * len(LABELS), encoder)
    for turn in range(2):
        made = training_pairs(kept, seed + turn, encoder)
        rows, owners = [[] for _ in LABELS], [[] for _ in LABELS]
        for start in range(0, len(made), 2048):
            for label, (places, sizes, owner) in enumerate(encoder.encode([(p, r) for _, p, r, _ in made[start : start + 2048]])):
                rows[label] += np.split(places, np.cumsum(sizes)[:-1])
                owners[label] += [start + k for k in owner]
        held = [zlib.crc32(f"{seed} {row}".encode()) % 5 == 0 for row, *_ in made]
        learned = {y for (*_, y), h in zip(made, held) if not h}
        weights = _fit([[x for x, k in zip(r, o) if not held[k]] for r, o in zip(rows, owners)], [[made[k][-1] for k in o if not held[k]] for o in owners], epochs, rate, decay, seed + turn)
        thresholds = []
        for label, name in enumerate(LABELS):
            if not {"", name} <= learned:
                thresholds.append(float("inf"))  # nothing to tell this label by
                continue
            top: dict[int, float] = {}
            for x, k in zip(rows[label], owners[label]):
                if held[k] and made[k][-1] in ("", name):
                    top[k] = max(top.get(k, -np.inf), float(weights[x].sum()))
            scored = sorted((score, made[k][-1] == name, 1 if made[k][-1] else 4) for k, score in top.items())
            errors = best = sum(w for _, y, w in scored if not y)
            stretch = [-2.0, -2.0]
            for k, (score, y, w) in enumerate(scored):
                errors += w if y else -w
                upper = scored[k + 1][0] if k + 1 < len(scored) else score + 1
                if errors < best and upper - score > 1e-6:  # equal scores stay together
                    best, stretch = errors, [score, upper]
            # Made defects are plainer than true ones, and wording that was never seen scores near 0, so 0 is not left far behind.
            thresholds.append(min(max(sum(stretch) / 2, -1.5), 0.75))
        model = PairModel(weights, thresholds, encoder)
        if turn == 0:
            if not learned or not sample:
                break
            scores = model.scores(sample) + np.where(np.array(LABELS) == "refusal", 0, sure)
            kept = [x for x, top in zip(sample, scores.max(1)) if top < 0]
            if not kept:
                break
    return model


def _within(sizes: Iterable[tuple[int, int]], most: int) -> list[int]:
    """Keys in order, as far as the sum of their sizes stays within ``most``; one that would exceed it is passed over."""
    taken, left = [], most
    for key, size in sizes:
        if size <= left:
            taken.append(key)
            left -= size
    return taken


def training_sample(df: DataFrame, id_col: str, prompt_col: str, response_col: str, sample_rows: int = 4000, sample_bytes: int = 8_000_000) -> list[tuple[str, str]]:
    """Whole pairs to learn from: the ``sample_rows`` answered ones of lowest id hash, and fewer where these have over
    ``sample_bytes`` bytes together; a pair that would exceed it is passed over, no text is cut."""
    pairs = _pairs(df, id_col, prompt_col, response_col)
    hashed = pairs.where(F.length("response") > 0).withColumn("_order", F.xxhash64("id"))
    last = hashed.select("_order").distinct().orderBy("_order").limit(sample_rows).agg(F.max("_order")).first()[0]  # hashes only are shuffled
    if last is None:
        return []
    chosen = hashed.where(F.col("_order") <= last).withColumn("_pair", F.xxhash64("_order", "prompt", "response"))
    sizes = chosen.select("_order", "_pair", (F.octet_length("prompt") + F.octet_length("response")).alias("size")).distinct().orderBy("_order", "_pair").limit(sample_rows).collect()
    taken = _within(((r["_pair"], r["size"]) for r in sizes), sample_bytes)
    if not taken:
        return []
    rows = chosen.where(F.expr(f"_pair IN ({', '.join(f'{k}L' for k in taken)})")).select("_order", "_pair", "prompt", "response").distinct().orderBy("_order", "_pair").collect()
    return [(r["prompt"], r["response"]) for r in rows]


def _pairs(df: DataFrame, id_col: str, prompt_col: str, response_col: str) -> DataFrame:
    return df.where(F.col(prompt_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(prompt_col).alias("prompt"), F.col(response_col).alias("response"))


def pair_defects(df: DataFrame, *, id_col: str, prompt_col: str, response_col: str, sample_rows: int = 4000, sample_bytes: int = 8_000_000, model: PairModel | None = None) -> DataFrame:
    """Defective pairs ``(id, defect)``, each once: the first that fits of ``empty``, ``copied``, ``refusal``,
    ``truncated``, ``language``.

    ``empty`` is a response that is null or has no letter or digit. The other labels come from a linear model; without
    a ``model`` one is trained here, on a :func:`training_sample` (its bounds are those on what the driver holds).
    Every row is judged, on whole texts. Rows with a null prompt are no pairs and
    must be left out by the caller's filter; they are skipped here. Copies of a row count once. Without any pair to learn from only ``empty`` comes out.
    """
    pairs = _pairs(df, id_col, prompt_col, response_col)
    model = model or fit(training_sample(df, id_col, prompt_col, response_col, sample_rows, sample_bytes))
    sent = df.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator) -> Iterator:
        for pdf in batches:
            pairs = list(zip(pdf["prompt"], pdf["response"]))
            once = list(dict.fromkeys(pairs))
            named = dict(zip(once, sent.value.defects(once)))
            out = pdf[["id"]].assign(defect=[named[x] for x in pairs])
            yield out[out["defect"].notna()]

    kind = df.schema[id_col].dataType.simpleString()
    return pairs.mapInPandas(judge, f"id {kind}, defect string").distinct().select(F.col("id").alias(id_col), "defect")
