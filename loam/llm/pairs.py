"""Broken prompt and response pairs, with every defect that shows.

Method: ordered rules - emptiness, copied prefixes, multilingual refusal phrases, unclosed delimiters and abrupt
endings, script and language mismatch. Every triggered defect type is emitted, in the order of ``DEFECTS``; the
first is the pair's main defect.

Defined results
- a null, blank or mark-only reply, an empty shell (``{}``, an empty fence, a bare label) or a placeholder is
  ``empty`` and nothing else;
- a null or blank question leaves ``copy`` and ``language`` untriggered;
- labels such as ``[Reply 1]``, ``Answer:`` or ``Q:`` are no content;
- code, quotations, addresses and one opening word say nothing about a reply's language;
- replies of any length are read whole; repeated rows each get their result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from loam.session import spread

DEFECTS = ("empty", "copy", "refusal", "truncated", "language")

_FENCED = re.compile(r"(?ms)^\s*(`{3,}|~{3,})[^\n]*\n.*?(?:^\s*\1[`~]*\s*$|\Z)")
_LABEL = re.compile(r"(?im)^\s*(?:[*_#>\-\s]*)(?:\[?(?:reply|respuesta|antwort|réponse|part)\s*\d+(?:\s*of\s*\d+)?\]?|(?:question|frage|pregunta|q|answer|antwort|réponse|respuesta|reply|response|a|you asked|your question|sie fragten|vous avez demandé|usted preguntó)\s*[:：])[*_]*\s*")
_WORD = re.compile(r"[^\W_]+")
_URL = re.compile(r"(?:https?://|www\.)\S+")
_SENTENCE = re.compile(r"(?<=[.!?。！？…])[\"'”»)\]]*\s+|(?<=[。！？])|\n+")
_PLACEHOLDER = {
    "empty", "noresult", "null", "none", "nil", "na", "nan", "tbd", "todo", "noanswer", "answer", "reply", "response", "undefined", "unknown",
    "placeholder", "pending", "missing", "blank", "noresponse", "noreply", "notavailable", "notapplicable", "error", "leer", "vacío", "vide", "keine", "sinrespuesta",
}


def _bare(text: str) -> str:
    """Letters, digits and their marks only, lower-cased."""
    return "".join(c for c in text.lower() if c.isalnum())


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    text = re.sub(r"<[^<>]*>|&nbsp;", " ", answer) if "<" in answer or "&" in answer else answer
    if not any(map(str.isalnum, text)):
        return True
    if "```" in text or "~~~" in text:
        inside = re.fullmatch(r"\s*(?:`{3,}|~{3,})\w*\s*(.*?)\s*(?:`{3,}|~{3,})\s*", text, re.S)
        text = inside.group(1) if inside else text
        if not any(map(str.isalnum, text)):
            return True
    words = _WORD.findall(text.lower())
    return len(words) < 5 and "".join(words) in _PLACEHOLDER


# --- copies -------------------------------------------------------------------------------------------------------


def _aligned(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two word lists; a column of the table is one integer's bits."""
    at: dict[str, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    free = full
    for x in a:
        met = free & at.get(x, 0)
        free = ((free + met) | (free - met)) & full
    return len(b) - free.bit_count()


def _repeats(asked: list[str], said: list[str]) -> tuple[int, int]:
    """How often the question is repeated in the reply, and the words left over on both sides, at the fewest left over.

    The question is a ring that the reply is aligned with (wraparound dynamic programming): cost is linear in the reply.
    """
    m = len(asked)
    row = [(j, 0) for j in range(m)]  # by words of the current repeat: words left over, repeats finished
    for x in said:
        new = [(cost + 1, done) for cost, done in row]
        for j in range(m):
            if asked[j] == x:
                cost, done = row[j]
                new[(j + 1) % m] = min(new[(j + 1) % m], (cost, done + (j == m - 1)))
        for j in [*range(m), *range(m)]:  # a word of the question left out; twice, as the ring closes
            cost, done = new[j]
            new[(j + 1) % m] = min(new[(j + 1) % m], (cost + 1, done + (j == m - 1)))
        row = new
    return row[0][1], row[0][0]


def is_copy(question: str, answer: str) -> bool:
    """Whether the reply is the question and nothing more: once or again, with a label, or with a word or so changed."""
    asked = _WORD.findall(question.lower())
    said = _WORD.findall(_LABEL.sub(" ", answer).lower())
    if len(asked) < 3 or len(said) < 3:
        return False
    spare = max(1, len(asked) // 12)
    times = max(1, round(len(said) / len(asked)))
    if abs(len(said) - times * len(asked)) > spare * times + 1:
        return False
    if times > 3:
        words = set(asked)
        if sum(x not in words for x in said) > spare * times:
            return False
        times, left = _repeats(asked, said)
        more = len(said) - times * len(asked)
        return left + abs(more) <= 2 * spare * times
    return len(said) - _aligned(said, asked * times) <= spare * times and _aligned(said, asked * times) >= times * (len(asked) - spare)


# --- refusals -----------------------------------------------------------------------------------------------------

#: A refusal is a clause in which somebody speaks for himself, may not or will not, and means to say or to give.
#: By language: who cannot, what is not done (beginnings of words), and refusals that are complete by themselves.
_CLAUSES = {
    "en": (
        r"\b(?:I|we)\b[^.;:!?]{0,25}?(?:\b(?:can(?:no|')?t|can not|could(?: not|n't)|will not|won't|would(?: not|n't)|must(?: not|n't)|may not|should(?: not|n't)|shall not|do(?: not|n't) (?:\w+ )?(?:want|wish|feel|intend|plan|have))\b|(?:\b(?:am|are|be|feel)|'m|'re) (?:\w+ )?(?:not (?:\w+ )?(?:able|allowed|permitted|authori[sz]ed|comfortable|willing|going|free|at liberty|in a position|here|qualified|equipped|supposed)|un(?:able|willing|authori[sz]ed|comfortable))\b|\bhave (?:no|to (?:decline|refuse)|been (?:asked|told|instructed))\b)|^(?:\w+,? )?(?:unable|not able|not allowed|not permitted|cannot|can't)\b",
        "answer help assist respon comment discuss provid shar say speak talk engag disclos reveal tell giv offer address advis fulfil compl support elaborat inform get go do avoid stay",
        r"\bI(?:'d| would)? (?:\w+ ){0,3}(?:rather|prefer) (?:not|to not)\b|\bI (?:\w+ ){0,3}(?:must |have to |will |shall |can only )?(?:decline|refuse|abstain|pass on (?:this|that|it)|skip (?:this|that|it)|leave (?:this|that|it)\b)|\b(?:I|we)(?: was| were| have been|'ve been| am| are) (?:\w+ )?(?:told|asked|instructed|advised)\b[^.;:!?]*\b(?:not|off|avoid|away|from)\b|\bI must (?:leave|decline|refuse)|must decline|\bpass on this one\b|(?:outside|beyond|not within|not part of)(?: of)? (?:what I|my|the (?:scope|bounds|limits|range|things|topics|subjects|questions))\b|\bno(?:t|thing) (?:(?:something|anything|a \w+|one|\w+) )?(?:that )?I(?: can| could| may| will|'m| am|'d)\b|\bno (?:\w+ )?I (?:can|could|may) (?:give|offer|share|provide)|\b(?:against|violates?) (?:my|our)\b|\bmy (?:\w+ )?(?:rules|guidelines|instructions|polic(?:y|ies)|programming) (?:keep|prevent|stop|do(?:es)? not|do(?:es)?n't|forbid|prohibit|bar)|(?:isn't|is not|not) (?:\w+ )?(?:possible|appropriate|permitted|allowed) for me\b|^request (?:\w+ )?(?:declined|denied|refused)|^no comment\b|\b(?:let us|let's) (?:\w+ )?talk about something else|\bask somebody else about",
    ),
    "de": (
        r"(?=[^.;:!?]*\b(?:ich|mir|wir|uns)\b)(?=[^.;:!?]*\b(?:nicht|nichts|kein\w*|niemals)\b)(?=[^.;:!?]*\b(?:kann|darf|möchte|werde|will|könnte|soll|sollte|muss|mag|bin|ist|wäre|können|dürfen|möchten|werden|sind|steht|habe|sage|gebe|äußere)\b)",
        "antwort beantwort helf weiterhelf hilf sag verrat mitteil mitzuteil äußer auskunft auskünft geb gib nenn kommentier bereit liefer stellung eingeh einzugeh sprech besprech dienen unterstütz erklär möglich gestattet erlaubt befugt berechtigt teilen behandel bearbeit",
        r"\b(?:lehne|verweigere|verweigern|lehnen)\b[^.;:!?]*\b(?:ich|wir|ab)\b|\bich (?:lehne|verweigere|muss (?:\w+ )*(?:passen|ablehnen|verweigern)|enthalte mich)|\bkeine auskunft\b|außerhalb (?:meine[rs]|dessen, was ich|der themen)|verst(?:ößt|oßen würde) gegen meine",
    ),
    "fr": (
        r"(?=[^.;:!?]*(?:\b(?:je|nous|me|moi)\b|\b[jm]'))(?=[^.;:!?]*(?:\bne\b|\bn'))(?=[^.;:!?]*\b(?:pas|rien|aucun\w*|point|saurais|puis)\b)",
        "répond aid comment fourn dire dis parl donn partag communiqu révél discut renseign trait assist explor aborder divulg possible permis",
        r"\b(?:je (?:refuse|décline|m'abstiens|dois (?:refuser|décliner)|préfère ne pas|préférerais ne pas)|hors de (?:ma|mes|mon|ce que je)|dépasse (?:mes|ce que je)|il m'est impossible|je suis (?:\w+ )?(?:incapable|dans l'impossibilité)|il ne m'est pas (?:possible|permis))\b",
    ),
    "es": (
        r"\b(?:no|nada|ningun\w*|tampoco)\b (?:\w+ ){0,3}?(?:puedo|podré|podría|debo|quiero|deseo|voy a|sabría|podemos|es posible|está permitido|estoy (?:autorizad|en condiciones|capacitad|dispuest)\w*)\b",
        "respond contest ayud coment decir dar darle proporcion compart habl revel facilit tratar ofrec inform discut opin atend",
        r"\bme niego\b|\brehúso\b|\b(?:declino|me abstengo|prefiero no|preferiría no)\b|fuera de (?:mis?|lo que)\b|\bva en contra de mis\b|\bme (?:es|resulta) imposible\b",
    ),
    "it": (
        r"\bnon (?:\w+ ){0,3}?(?:posso|potrò|potrei|voglio|devo|possiamo|è (?:possibile|permesso|consentito)|sono (?:autorizzat|in grado|tenut|abilitat|dispost)\w*)\b",
        "rispond aiut comment dire dirl forn condivid parl dare darl discut rivel comunic tratt",
        r"\bmi rifiuto\b|\bdeclino\b|\bprefer(?:isco|irei) non\b|fuori dalle mie\b",
    ),
    "pt": (
        r"\bnão (?:\w+ ){0,3}?(?:posso|poderei|poderia|quero|devo|vou|consigo|podemos|é (?:possível|permitido)|estou (?:autorizad|habilitad|apt)\w*)\b",
        "respond ajud coment dizer fornec compartilh partilh fal dar discut revel inform trat auxili",
        r"\brecuso(?:-me)?\b|\bme recuso\b|\bprefiro não\b|\bdeclino\b|\bfora (?:do meu|das minhas|do que)\b",
    ),
    "nl": (
        r"(?=[^.;:!?]*\b(?:ik|mij|wij|we)\b)(?=[^.;:!?]*\b(?:niet|geen|niets)\b)(?=[^.;:!?]*\b(?:kan|mag|wil|zal|ga|ben|is|kunnen|mogen)\b)",
        "antwoord beantwoord help zeg gev geef del bespre ingaan vertel verstrek mogelijk toegestaan reager",
        r"\bik weiger\b|\bik (?:\w+ )*liever niet\b|\bbuiten (?:mijn|wat ik)\b",
    ),
    "pl": (
        r"\bnie (?:\w+ ){0,2}?(?:mogę|chcę|będę|możemy|wolno mi|jestem w stanie|powinn\w+)\b",
        "odpow pomóc pomaga powiedz udziel komentow poda omawia rozmawia ujawni dostarcz",
        r"\bodmawiam\b|\bwolę nie\b|\bwolał\w*m nie\b",
    ),
    "sv": (
        r"(?=[^.;:!?]*\b(?:jag|jeg|vi|mig|meg)\b)(?=[^.;:!?]*\b(?:inte|ikke|ej|inget|intet|ingenting)\b)(?=[^.;:!?]*\b(?:kan|får|vill|vil|kommer|må|skal|ska|har|er|är)\b)",
        "svar hjälp hjælp hjelp säga sige si kommenter dela dele ge gi give diskut besvar uttal utal yttr oplys upplys",
        r"\b(?:jag|jeg) (?:avstår|avböjer|vägrar|afviser|nægter|nekter|avslår)\b|\b(?:jag|jeg) (?:\w+ )?(?:hellre|helst|helst vil) (?:inte|ikke)\b",
    ),
    "cjk": (
        r"(?!)",
        "",
        r"(?:不能|无法|不可以|不便|不方便|没有办法|没办法|恕我|恕难|不愿|不会|不予|不想)[^，。；：！？]{0,6}(?:回答|提供|协助|回应|帮助|透露|讨论|告诉|评论|解答|分享|说明|帮忙)|拒绝(?:回答|提供|回应)|超出了?我的|(?:お答え|回答|お手伝い|対応|ご提供|提供|お伝え|お話し)(?:することが|することは|は|が|を)?(?:でき(?:ません|かね)|いたしかね|控え)|お断り|답변(?:드릴|할) 수 없|도와드릴 수 없",
    ),
    "ru": (
        r"\bне (?:\w+ ){0,2}?(?:могу|буду|хочу|имею права|вправе|готов\w*|можем)\b",
        "ответ отвеч помо сказ предостав обсужд комменти раскры дел говор сообщ",
        r"\bотказываюсь\b|\bпредпочитаю не\b",
    ),
}
#: Courtesies around a refusal that answer nothing.
_COURTESY = [
    r"^(?:oh|hmm+|well|ok(?:ay)?|hello|hi|sorry|unfortunately|perdone|désolé|leider|lo siento|bonjour|hallo|hola|guten tag)?[\s,.!;:—-]*$",
    r"thank(?:s| you)|danke|vielen dank|merci|gracias",
    r"\bI(?:'m| am) (?:so |very |truly )?(?:sorry|afraid)\b(?! .{80})|\bI (?:apologi[sz]e|regret)\b|^sorry\b|tut mir leid|entschuldigung|je regrette|désolé|lo siento|lamento|disculpe|perdone",
    r"please (?:ask|rephrase|contact|consult|try|reach)|bitte wenden|merci de contacter|veuillez contacter|consulte con|contacte con|póngase en contacto",
    r"anything else|can I help|kann ich sonst|autre chose|algo más|puedo ayudar(?:le)? en|sonst noch",
    r"^that is a good question\b|^that's a good question\b|\bgood question\b|is a topic many ask about|gute frage|bonne question|buena pregunta|\btopic (?:many|people) ask\b",
    r"^as an? (?:ai )?(?:assistant|language model)\b|^als assistent|^en tant qu'assistant|^como asistente",
    r"you (?:would|will) have to ask|understand(?:ing)?\.?$|verständnis|compréhension|comprensión",
]
_CLAUSE = [(re.compile(who, re.I), re.compile(r"\b(?:" + "|".join(what.split()) + ")", re.I)) for who, what, _ in _CLAUSES.values() if what]
_WHOLE = re.compile("|".join(f"(?:{whole})" for _, _, whole in _CLAUSES.values()), re.I)
#: Words without which nothing is declined, in any of the languages; a sentence without one is not looked at.
_NEGATIVE = frozenset(
    "t not cannot cant no nothing none unable unwilling unauthorized unauthorised uncomfortable decline declined declining refuse refused refusing abstain skip pass rather unanswered outside beyond against violate violates policy policies guidelines rules "
    "instructions programming denied else off avoid away "
    "nicht nichts kein keine keinen keinem keiner keines keinerlei niemals lehne lehnen verweigere verweigern passen außerhalb gegen enthalte "
    "ne n pas rien aucun aucune aucuns aucunes impossible incapable décline abstiens préfère préférerais hors dépasse refuser décliner "
    "nada ningun ningún ninguna ninguno tampoco imposible niego rehúso declino abstengo prefiero preferiría fuera contra "
    "non rifiuto preferisco preferirei fuori não recuso fora niet geen niets weiger liever buiten nie odmawiam wolę wolałbym wolałabym inte ikke ej inget intet ingenting avstår avböjer vägrar afviser nægter nekter avslår hellre helst "
    "не отказываюсь предпочитаю".split()
)
_NEGATIVE_SIGN = re.compile("[不无没恕拒超]|でき|かね|控え|お断り|없")
#: Words one of which each courtesy of more than four words holds.
_POLITE_WORDS = frozenset(
    "oh hmm well ok okay hello hi sorry unfortunately thank thanks afraid apologise apologize regret please anything help question topic assistant model ask understand understanding "
    "perdone désolé désolée leider siento bonjour hallo hola danke dank merci gracias leid entschuldigung regrette lamento disculpe bitte veuillez consulte contacte contacter póngase sonst autre algo ayudar ayudarle frage pregunta assistent asistente "
    "verständnis compréhension comprensión".split()
)
_POLITE = re.compile("|".join(f"(?:{p})" for p in _COURTESY), re.I)
_BUT_HERE = re.compile(r"(?i)\bbut (?:in general|here is|here's|generally|what I can say)\b|\bin general\s*:|aber (?:allgemein|so viel)|mais (?:en général|voici)|pero (?:en general|esto)")


def _may_decline(text: str, words: list[str]) -> bool:
    return not _NEGATIVE.isdisjoint(words) or (not text.isascii() and _NEGATIVE_SIGN.search(text) is not None)


def _declines(sentence: str, words: list[str]) -> bool:
    """Whether a sentence declines: it is a refusal as a whole, or one who cannot and what is not done stand in one clause."""
    if not _may_decline(sentence, words):
        return False
    if _WHOLE.search(sentence):
        return True
    for who, what in _CLAUSE:
        m = who.search(sentence)
        # what is not done stands after it, or, where the clause was looked at as a whole, anywhere
        if m and what.search(sentence, m.end() if m.end() > m.start() else 0):
            return True
    return False


def is_refusal(answer: str) -> bool:
    """Declines, and nothing else in the reply answers."""
    text = answer.replace("’", "'")
    if not _may_decline(text, _WORD.findall(text.lower())):
        return False
    text = _LABEL.sub(" ", text)
    declined = False
    for sentence in _SENTENCE.split(text):
        sentence = sentence.strip(" \t\"'“”*_")
        words = _WORD.findall(sentence.lower())
        if not words:
            continue
        if _declines(sentence, words):
            declined = True
            # a clause after a colon goes on to answer
            rest = sentence.rpartition(":")[2] if ":" in sentence else ""
            if len(_WORD.findall(rest)) > 5 and not _declines(rest, _WORD.findall(rest.lower())):
                return False
        elif len(words) > 4 and _POLITE_WORDS.isdisjoint(words) or not _POLITE.search(sentence):
            return False  # a sentence of content: no need to read on
    return declined and not _BUT_HERE.search(text)


# --- truncation ---------------------------------------------------------------------------------------------------

#: Words that cannot end a sentence, an entry or a short answer.
_OPEN_WORDS = frozenset(
    "a an the and or but nor of to at by for from with without into onto than that which who whose because since so if when while whether as is are was were be been has have had "
    "must may can could should would will only its their our your his her my this these those between both each every until near per it "
    "der die das den dem des ein eine einen einem einer und oder aber nicht mit ohne für von zu zum zur im in an am auf aus bei nach vor über unter durch als wenn weil dass sowie noch weder sind ist wird werden sonst seit bis "
    "le la les un une des du de et ou mais ni avec sans pour par dans sur sous en au aux que qui dont si sont est où ne se plus leur il faut chaque depuis "
    "el los las una unos unas y o pero ni con sin para por en del al que se su sus es son como desde después también no "
    .split()
)
_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«", "』": "『", "」": "「", "）": "（", "】": "【"}
_OPENERS = frozenset(_PAIRS.values())
_BRACKETS = re.compile("[" + re.escape("".join([*_PAIRS, *_PAIRS.values()])) + "]")
_END = re.compile(r"[.!?。！？][\"'”’»)\]*_]*$")
_ENTRY = re.compile(r"^\s*(?:[-*•+]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+(.*)$")


def _unclosed(text: str) -> bool:
    """Whether a bracket or a directed quote is still open at the end."""
    open_: list[str] = []
    text = re.sub(r"(?m)^\s*\(?\w{1,3}\)\s", " ", text)  # numbering
    for c in _BRACKETS.findall(text):
        if c in _OPENERS:
            open_.append(c)
        elif c in _PAIRS and open_ and open_[-1] == _PAIRS[c]:
            open_.pop()
    return any(c != "“" or "„" not in text for c in open_) and bool(open_)


def is_truncated(answer: str) -> bool:
    """Whether the reply breaks off before its sentence, entry, bracket or code is finished."""
    text = answer.replace("\r\n", "\n").rstrip()
    fence = None
    for line in text.split("\n"):
        run = re.match(r"\s*(`{3,}|~{3,})", line)
        if run and fence is None:
            fence = run.group(1)
        elif run and line.strip() == fence:
            fence = None
    if fence is not None:
        return True
    if re.search(r"(?:`{3,}|~{3,})$", text):
        return False
    prose = re.sub(r"(?ms)^\s*(`{3,}|~{3,})[^\n]*\n.*?^\s*\1\s*$", "\n", text)
    if _unclosed(prose):
        return True
    lines = [x for x in text.split("\n") if x.strip()]
    last = lines[-1].strip()
    if re.search(r"\s(?:…|\.\.\.)$", text):  # trailing off after a finished sentence: judged as the sentence before it
        ended = _WORD.findall(last)
        return not ended or ended[-1].lower() in _OPEN_WORDS or bool(re.search(r"[,:;\-–—(]\s*(?:…|\.\.\.)$", last))
    if re.search(r"(?:…|\.\.\.)[\"'”’»)\]]*$", text):
        return True
    if _END.search(last):
        return False
    return _broken_end(last, lines)


def _broken_end(last: str, lines: list[str]) -> bool:
    words = _WORD.findall(last)
    if not words:
        return last.endswith(("\\", ",", ":", ";", "-", "–", "—", "("))
    if _URL.search(last.split()[-1]):
        return False
    if last[-1] in ",:;-–—\\/&+=(":
        return True
    if len(words) > 1 and words[-1].lower() in _OPEN_WORDS and not last.endswith((")", "]", "”", "»", '"')):
        return True
    if entry := _ENTRY.match(last):
        # entries are fragments; one that starts like a sentence among fragments is a sentence that broke off
        body = entry.group(1)
        others = [m.group(1) for x in lines[:-1] if (m := _ENTRY.match(x.strip()))]
        if others and body[:1].isupper() and sum(x[:1].islower() for x in others) > len(others) / 2 and not any(x[:1].isupper() for x in others if not _END.search(x)):
            return True
        return False
    if last[-1] in ")]”»\"'*_|":
        return False
    if re.search(r"[一-鿿ぁ-ヿ]$", last):
        return len(last) > 12
    tail = re.split(r"(?<=[.!?])\s+", last)[-1]
    if tail != last or len(_LABEL.sub("", last).split()) > 5:
        # a sentence of its own without an end, unless it is a short fragment after a label
        return True
    return False


# --- language -----------------------------------------------------------------------------------------------------

#: Function words that tell languages apart.
_FUNCTION = {
    "en": "the of and to is are was were for with without from that this which who whose must may can cannot should has have had not only when where how what why does do did it its by on at before after until because since each every both nobody you your my i we our they their if whenever or an a one in as so be up than there more over under about please no keep yes",
    "de": "der die das den dem des und ist sind war waren wird werden für mit ohne von zu zum zur im nicht nur wenn wer wie wo was warum auch bei nach vor bis seit durch weder noch ein eine einen einem einer sich lassen sonst müssen gelten es auf aus um innerhalb sollte bitte",
    "fr": "le la les des du et est sont était étaient pour avec sans par dans sur sous que qui où il elle faut ne pas ni avant après depuis jusqu chaque une un ces cette si plus ai je vous leur au aux combien quand comment pourquoi doivent être veuillez de l d on à en",
    "es": "el los las del y es son era eran para con sin por que quien se hay no ni después desde hasta una uno cada cuando como dónde cuánto cuántos también solo debe deben su sus lo al si ya tengo qué quién la de en un a estaban",
    "it": "il lo gli della delle dei degli del e è sono per con senza che non viene vengono di una un la le nel nella dal anche prima dopo ogni si firma richiesta al i o da",
    "pt": "os as do da dos das e é são para com sem que não uma um o a no na pelo pela será ser também antes depois cada se sua seu à ao pedido em de",
    "nl": "de het een en is zijn was voor met zonder van te niet wordt worden dat die deze dit bij naar door ook of op aan maar wie wat waar hoe er geen om in uit",
}
#: The same for languages that share many words with those above; they need two votes more than any other.
_FURTHER = {
    "sv": "och att det är som på för med av inte den till ett har de om var vid från eller efter under ska måste inom kan bara när hur vad varför även mellan utan innan blir alla",
    "da": "og at det er som på for med af ikke den til et har de om var ved fra eller efter under skal inden kun når hvordan hvad hvorfor også mellem uden før bliver alle blev kun",
    "no": "og at det er som på for med av ikke den til et har de om var ved fra eller etter under skal må innen kun når hvordan hva hvorfor også mellom uten før blir alle ble bare",
    "pl": "i w na z do nie się jest to że przez dla od po przed jak co kto gdzie kiedy który która które oraz lub ale są być może musi należy tylko także bez aby został będzie",
    "cs": "a v na z do ne se je to že pro od po před jak co kdo kde kdy který která které nebo ale jsou být může musí pouze také bez aby byl bude podle",
    "ro": "și în la cu de nu se este că pentru din după înainte cum ce cine unde când care sau dar sunt fi poate trebuie doar fără a fost va prin între pe",
    "tr": "ve bir bu için ile de da değil olarak gibi daha kadar sonra önce ama veya ne nasıl nerede olan olduğu edilir gerekir sadece yok var her",
    "fi": "ja on ei se että hän joka kun niin myös mutta tai jos ovat voi pitää ennen jälkeen ilman mukaan vain missä milloin miten mitä kuka olla oli tämä",
    "hu": "a az és nem van hogy ez egy de vagy meg kell csak után előtt nélkül szerint mint ha mi hol mikor hogyan aki ami volt lesz minden",
    "id": "dan yang di ke dari untuk dengan tidak ini itu adalah pada oleh akan dapat harus atau juga sebelum sesudah setelah hanya bagaimana siapa kapan dalam",
}
_LANGS = (*_FUNCTION, *_FURTHER)
_FEW = len(_FUNCTION)
#: By word, one count for each language that uses it, in a field of 24 bits of one integer: words are counted by adding.
_COUNTS: dict[str, int] = {}
for _k, _words in enumerate([*_FUNCTION.values(), *_FURTHER.values()]):
    for _word in set(_words.split()):
        _COUNTS[_word] = _COUNTS.get(_word, 0) | 1 << (24 * _k)
_NAMES = {
    "en": "english|englisch|anglais|inglés", "de": "german|deutsch|allemand|alemán", "fr": "french|französisch|français|francés",
    "es": "spanish|spanisch|espagnol|español|castellano", "it": "italian|italienisch|italien|italiano", "pt": "portuguese|portugiesisch|portugais|portugués",
    "nl": "dutch|niederländisch|néerlandais|neerlandés|holandés", "sv": "swedish|schwedisch|suédois|sueco", "da": "danish|dänisch|danois|danés", "no": "norwegian|norwegisch|norvégien|noruego", "pl": "polish|polnisch|polonais|polaco",
    "cs": "czech|tschechisch|tchèque|checo", "ro": "romanian|rumänisch|roumain|rumano", "tr": "turkish|türkisch|turc|turco", "fi": "finnish|finnisch|finnois|finés", "hu": "hungarian|ungarisch|hongrois|húngaro", "id": "indonesian|indonesisch|indonésien|indonesio", "zh": "chinese|chinesisch|chinois|chino|中文|汉语", "ja": "japanese|japanisch|japonais|japonés", "ru": "russian|russisch|russe|ruso",
}
_ASKED_FOR = {lang: re.compile(rf"(?i)(?:\bin|\bauf|\ben|\binto|\bins|\bal|用|以)\s*(?:plain |simple |einfachem |the )?(?:{names})\b|\b(?:{names})\b[^.?!]{{0,20}}(?:please|bitte|s'il vous plaît|por favor)") for lang, names in _NAMES.items()}
_NAME = frozenset("|".join(_NAMES.values()).split("|"))
_SCRIPTS = [("zh", r"[一-鿿]"), ("ja", r"[぀-ヿ]"), ("ko", r"[가-힯]"), ("ru", r"[Ѐ-ӿ]"), ("ar", r"[؀-ۿ]"), ("el", r"[Ͱ-Ͽ]"), ("he", r"[֐-׿]"), ("th", r"[฀-๿]"), ("hi", r"[ऀ-ॿ]")]
_SCRIPTS = [(lang, re.compile(p)) for lang, p in _SCRIPTS]


_MARKS = [("de", frozenset("äöüß")), ("fr", frozenset("çèêàùœîôû")), ("es", frozenset("ñ¿¡áíóú")), ("pt", frozenset("ãõ"))]


_QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"\n]*\"")
_LETTERS = re.compile(r"[^\W\d_]+")
_WIDE = re.compile(r"[一-鿿぀-ヿ]")
_ZEROS = repeat(0)


def language_of(text: str) -> str | None:
    """The language of a stretch of text: by script, else by function words; None where nothing tells."""
    words = _LETTERS.findall(text.lower())
    if not words:
        return None
    plain = text.isascii()
    if not plain:
        letters = sum(map(len, words))
        for lang, script in _SCRIPTS:
            if len(script.findall(text)) * 3 > letters:
                return lang
    total = 0
    for k in range(0, len(words), 1 << 20):  # a field holds no more
        total += sum(map(_COUNTS.get, words[k : k + (1 << 20)], _ZEROS))
    if not total:
        return None
    scores = [float(total >> (24 * k) & 0xFFFFFF) for k in range(len(_LANGS))]
    if not plain:
        low = text.lower()
        for lang, marks in _MARKS:
            scores[_LANGS.index(lang)] += 0.5 * (not marks.isdisjoint(low))
    best = max(scores)
    few = max(scores[:_FEW])
    if best >= few + 2 and best > few * 1.5:
        return _LANGS[scores.index(best)] if scores.count(best) == 1 else "other"
    return _LANGS[scores.index(few)] if few >= 1 and scores[:_FEW].count(few) == 1 else None


def is_foreign(question: str, answer: str) -> bool:
    """Whether most of the reply's own prose is in a language that was neither used nor asked for."""
    asked = language_of(question)
    if asked is None:
        return False
    fine = {asked}
    if not _NAME.isdisjoint(_WORD.findall(question.lower())) or "中文" in question or "汉语" in question:
        fine |= {lang for lang, p in _ASKED_FOR.items() if p.search(question)}
    text = answer.replace("’", "'")
    if "```" in text or "~~~" in text:
        text = _FENCED.sub("\n", text)
    text = _URL.sub(" ", _LABEL.sub(" ", _QUOTED.sub(" ", text)))
    votes: Counter[str] = Counter()
    for sentence in _SENTENCE.split(text):
        words = _WORD.findall(sentence)
        cjk = 0 if sentence.isascii() else len(_WIDE.findall(sentence))
        if len(words) < 3 and cjk < 3:
            continue
        if (lang := language_of(sentence)) is not None:
            votes[lang] += max(len(words), cjk // 2)
    own = sum(n for lang, n in votes.items() if lang in fine)
    return sum(votes.values()) > 2 * own


def defects_of(question: str | None, answer: str | None) -> list[str]:
    """All defects of a pair, in the order of ``DEFECTS``."""
    if is_empty(answer):
        return ["empty"]
    found = []
    asked = question if question and question.strip() else None
    if asked and is_copy(asked, answer):
        found.append("copy")
    if is_refusal(answer):
        found.append("refusal")
    if is_truncated(answer):
        found.append("truncated")
    if asked and is_foreign(asked, answer):
        found.append("language")
    return found


def _all_defects(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for questions, answers in batches:
        yield pd.Series([defects_of(q, a) for q, a in zip(questions, answers)], dtype=object)


def broken_pairs(df: DataFrame, key: str = "pos", question: str = "question", answer: str = "actual_answer", run: str | None = "turns") -> DataFrame:
    """``(key, defects)`` of every pair that was run and has a defect. A map over the scan: no shuffle."""
    pair_defects = F.pandas_udf(_all_defects, ArrayType(StringType()))
    rows = spread((df.where(F.col(run).isNotNull()) if run else df).select(key, question, answer))
    found = rows.select(F.col(key), pair_defects(F.col(question), F.col(answer)).alias("defects"))
    return found.where(F.size("defects") > 0)
