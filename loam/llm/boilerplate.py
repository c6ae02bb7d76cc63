"""Main body of pages: the lines of menus, notices, sidebars and footers that a site repeats around its content.

Method: site style tree. A page's text is read as a small DOM - blocks of lines, each line with a presentation
(heading, paragraph, list entry, row of entries, link, code, and the role its wording gives it, as a class
attribute would) and with content. The trees of all pages of a host are merged:

- a *content* leaf (a menu or prompt entry, a paragraph or a long list entry) has importance ``1 - log(f) / log(m)``: 1 - the entropy of its pages,
  where f of the host's m distinct pages hold it. What is on one page only is important, what is on all is not;
- a sentence with a role whose opening occurs once among all pages is content: nothing repeats it;
- a *presentation* node (a role) has, on each host, the entropy of its contents over that of its occurrences: a role
  that says the same few things again and again is unimportant. Few occurrences tell little, so the host's value is
  averaged with that of all hosts, and that one with 0 (the wording alone), which count as ``PRIOR`` occurrences;
- a branch (a block) has the mean importance of its leaves, and is removed if that is low; paragraphs, long list
  entries and rows of entries are branches of their own.

Pages that are copies of each other count as one, so that repeated content does not look like furniture.

Defined results
- null and blank texts have no lines; lines are counted from 0 after CRLF became LF; blank lines are never cases;
- headings, tables, code and the heading path that may open a text are never cases;
- a chunk id counts once, under the least of its ``kb_path``; a null ``kb_path`` is a host of its own;
- texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from re import _constants as re_constants
from re import _parser as re_parser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.session import staged

LOW = 0.55  # branches under this importance are removed
LEAST_SEEN = 3  # pages that must hold an entry before its own statistics count
ROLE_LOW, PRIOR = 0.8, 10
WORDS = 6  # what is longer is a sentence, not an entry

#: Wording that gives a line its role on a page, in the languages of the corpus.
ROLES = {
    "skip": r"^(?:skip|jump|go) (?:to )?(?:the )?(?:main )?(?:content|navigation|menu)\.?$|^(?:zum (?:haupt)?inhalt(?: springen)?|navigation überspringen|aller au (?:contenu|menu)(?: principal)?|passer (?:la navigation|au contenu)|(?:ir|saltar) al (?:contenido|menú)(?: principal)?|saltar (?:la )?navegación)$",
    "cookie": r"^(?:we|this (?:web)?site|these pages|our (?:web)?site|.{0,60} and its partners|like most sites,? .{0,60}) (?:\w+ ){0,3}(?:use|uses|store|stores|set|sets|relies on|rely on|place|places)\b.{0,40}(?:cookies?|small files|trackers?)|^.{0,60}\b(?:small files on your device|kleine dateien auf (?:ihrem|deinem) gerät|petits fichiers sur votre appareil|pequeños archivos en su (?:dispositivo|equipo))|^your privacy matters|^cookies? (?:help|on this|and privacy|notice|settings?$)|^by (?:continuing|staying|using).{0,80}(?:cookies|agree)|^(?:wir|diese (?:web)?(?:seite|site)|unsere (?:web)?(?:seite|site)|.{0,60} und (?:seine|ihre) partner) (?:\w+ ){0,3}(?:verwende[nt]|nutz(?:en|t)|setz(?:en|t)|speicher[nt]|benutz(?:en|t)).{0,40}(?:cookies|dateien)|^(?:nous|ce site|notre site|.{0,60} et ses partenaires) (?:\w+ ){0,3}(?:utilis\w+|dépos\w+|stock\w+|enregistr\w+|emplo\w+).{0,40}(?:cookies|fichiers|traceurs)|^(?:usamos|utilizamos|empleamos|este sitio|esta web|nuestro sitio|.{0,60} y sus socios)\b.{0,40}(?:cookies|archivos|rastreadores)|^(?:ihre privatsphäre|votre vie privée|su privacidad|tu privacidad)\b.{0,20}(?:wichtig|compte|importe|importa)",
    "button": r"^(?:reject (?:optional|all)(?: cookies)?|accept (?:all|cookies|and close)(?: cookies)?|ok,? got it|got it|save choices|save (?:settings|preferences)|manage (?:settings|cookies|preferences|choices)|cookie settings|nur notwendige(?: cookies)?|(?:nur notwendige|alles?) (?:akzeptieren|ablehnen|annehmen|zulassen)|ablehnen|akzeptieren|annehmen|einstellungen|auswahl speichern|verstanden|tout (?:accepter|refuser)|accepter|refuser|paramétrer|personnaliser|enregistrer|j'ai compris|aceptar(?: todo| todas)?|rechazar(?: todo| todas)?|configurar|guardar|entendido)$",
    "crumb": r"^(?:(?:you are here|sie sind hier|vous êtes ici|está aquí|usted está aquí|estás aquí)\s*:.*|(?:home|start(?:seite)?|accueil|inicio)\s*(?:[»>›|/·→]|::).+)$",
    "related": r"^(?:related (?:pages|articles|links|content|topics)|see also(?: on this site)?|more in this section|popular (?:topics|pages|articles)|people also (?:read|viewed|ask)|you may also like|read next|further reading on this site|verwandte (?:seiten|artikel|themen)|mehr (?:zum thema|in (?:diesem|dieser) (?:bereich|rubrik))|siehe auch|beliebte (?:themen|seiten)|das (?:könnte|lesen) .{0,30}|auch interessant|pages liées|dans la même rubrique|à lire aussi|voir aussi|sujets populaires|articles liés|páginas relacionadas|también le puede interesar|más en esta sección|temas populares|véase también|ver también|lo más leído)\s*:?$",
    "share": r"^(?:share|teilen|partager|compartir)$|^(?:share this(?: page| article)?|seite teilen|diese seite teilen|partager(?: cette page)?|compartir(?: esta página)?)\s*:.*$|^share this (?:page|article)$|^(?:tell a friend|follow us\b.*|folgen sie uns\b.*|suivez-nous\b.*|síganos\b.*|weitersagen|einem freund (?:senden|empfehlen)|envoyer à un ami|recommander|enviar a un amigo|recomendar)$|^(?:print (?:this )?page|seite drucken|diese seite drucken|drucken|imprimer(?: (?:la|cette) page)?|imprimir(?: (?:esta|la) página)?)$",
    "rate": r"^(?:rate this (?:article|page)|bewerten sie .{0,30}|artikel bewerten|évaluez? .{0,30}|notez .{0,30}|valore .{0,30}|califique .{0,30})\b[\s:]*[\d★☆* ]*$|^¿?\s*(?:was this (?:page|article) (?:helpful|useful)|war diese seite hilfreich|hat (?:ihnen )?diese seite geholfen|cette page vous a-t-elle (?:été utile|aidée?)|le ha sido útil|le resultó útil|te ha sido útil|fue útil(?: esta página)?|ha sido útil esta página)\s*\?.{0,20}$",
    "news": r"^(?:subscribe to our newsletter\b.*|sign up (?:for|to) (?:our newsletter|alerts|updates)\b.*|get alerts\b.*|(?:abonnieren sie|jetzt|melden sie sich).{0,40}newsletter.*|newsletter abonnieren.*|abonnez-vous à notre (?:lettre|newsletter|bulletin).*|inscrivez-vous.{0,50}|recevez nos (?:alertes|nouvelles).*|suscríbase a nuestro boletín.*|suscríbete.{0,40}|reciba (?:alertas|avisos).*|(?:hinweise|meldungen|benachrichtigungen) per e-mail.*|alertes par (?:e-mail|courriel).*|alertas por correo.*)$",
    "app": r"^(?:get|download) (?:the |our )?(?:.{1,50} )?app\b.*$|^(?:holen|laden) sie (?:sich )?(?:die|unsere) .{0,50}app\b.*$|^(?:téléchargez|installez) (?:l'|notre |l’)(?:appli|application)\b.*$|^(?:descargue|descarga|instale) (?:la|nuestra) (?:app|aplicación)\b.*$",
    "page": r"^(?:«|‹|<|←|»|›|→|\W)*\s*(?:(?:previous|next) (?:page|article|chapter|topic)|(?:vorherige|nächste|vorige|folgende) (?:seite|artikel)|(?:page|article) (?:précédente?|suivante?)|(?:página|artículo) (?:anterior|siguiente))(?:\s*[:»›→-].*|\s*)$|^(?:« |‹ |← |< )?(?:previous|zurück|précédent|anterior|prev)\s*(?:[|/·]|\s{2,}|[»›→-])\s*(?:next|weiter|suivant|siguiente)(?: »| ›| →| >)?$",
    "top": r"^(?:\W*\s)?(?:back to (?:the )?top|top of (?:the )?page|to (?:the )?top|nach oben|(?:zum )?seitenanfang|zurück nach oben|haut de (?:la )?page|retour en haut(?: de (?:la )?page)?|volver arriba|ir arriba|arriba|subir)(?:\s\W*)?$",
    "copyright": r"^(?:©|\(c\)|copyright\b).{0,120}$|^all content ©.{0,80}$|^.{0,80}(?:all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados)\.?$|^.{0,60}©\s*(?:\d{4}|.{0,40}\d{4}).{0,40}$",
    "operator": r"^.{1,80} (?:is run by the .{1,80} from its house in .{1,60}|ist ein angebot (?:der|des|von) .{1,80}|(?:est|es) un servic[ei]o? de (?:la|l'|l’)\s?.{1,80}|is (?:a service|operated|published|run|provided) (?:of|by) .{1,80}|wird (?:betrieben|herausgegeben) von .{1,80})\.?$|^this (?:service|site|website) is (?:offered|operated|run|provided|published) by .{1,120}$|^(?:dieses angebot|diese seite) wird .{1,100}$|^(?:ce service|ce site) est (?:proposé|exploité|édité|géré) par .{1,100}$|^(?:este servicio|este sitio) (?:es|está) (?:ofrecido|operado|gestionado|publicado) por .{1,100}$|^(?:questions about this (?:web)?site|fragen zu dieser (?:web)?seite|des questions sur ce site|preguntas sobre (?:este sitio|esta web)|¿preguntas sobre .{1,30})\b.{0,140}$|^.{0,60}webmaster@\S+\.?$",
}
#: Entries that menus and legal rows commonly hold; importance 0 wherever they stand as entries.
LABELS = frozenset(
    "home|press|news|services|contact|about us|faq|log in|login|sign in|events|payments|careers|jobs|guides|forms|health|sport & leisure|law & order|software downloads|our offices|help|search|menu|imprint|"
    "privacy|privacy policy|terms of use|terms|cookie policy|accessibility|sitemap|site map|media kit|report a problem|legal notice|disclaimer|"
    "startseite|presse|aktuelles|nachrichten|leistungen|kontakt|über uns|anmelden|veranstaltungen|zahlungen|karriere|stellen|ratgeber|formulare|gesundheit|sport|hilfe|suche|impressum|datenschutz|nutzungsbedingungen|"
    "agb|barrierefreiheit|übersicht|inhalt|cookie-richtlinie|rechtliche hinweise|"
    "accueil|actualités|nouvelles|à propos|connexion|événements|paiements|carrières|emplois|formulaires|santé|sports|aide|recherche|mentions légales|confidentialité|conditions d'utilisation|accessibilité|plan du site|politique de cookies|"
    "inicio|prensa|noticias|servicios|contacto|quiénes somos|acceder|eventos|pagos|empleo|guías|formularios|salud|deporte|ayuda|buscar|aviso legal|privacidad|condiciones de uso|accesibilidad|mapa web|política de cookies"
    .split("|")
)

_ROLE = {name: re.compile(pattern, re.I) for name, pattern in ROLES.items()}
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_LINK = re.compile(r"\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\([^()\s]*\)")
_MARKER = re.compile(r"^\s*(?:[-*+•▪◦‣»›>]\s+|\d{1,3}[.)]\s+)")
_PLAIN = re.compile(r"[^\[\]()*_]*")  # plain ASCII without these has no decoration
_DECOR = re.compile(r"[▾▸▼►»›☰]|\((?:current|aktuell|actuel|actual)\)|\*\*|__|\[|\]", re.I)
_ADDRESSES = re.compile(r"\S+@\S+|https?://\S+")
_DIGITS, _PARTS = re.compile(r"\d+"), re.compile(r"[^\W_]+|[©@]")
_ROWISH = re.compile(r"[|·•›»/–\t]|\s\s")  # a line without these is no row
_ROW = re.compile(r"\s+[|·•›»/]\s+|\s{2,}|\t|\s+–\s+|\s*[|·]\s*")


def bare_entry(entry: str) -> str:
    """An entry's wording: no link target, marker, decoration or case."""
    if "](" in entry:
        entry = _LINK.sub(r"\1", entry)
    entry = entry.strip()
    if not entry[:1].isalpha():
        entry = _MARKER.sub("", entry)
    if not (entry.isascii() and _PLAIN.fullmatch(entry)):
        entry = _DECOR.sub(" ", entry)
    return " ".join(entry.split()).strip(" \t|·*_#:").lower()


def entries_of(line: str) -> list[str]:
    """The entries of a row, or the line as one entry."""
    if not _ROWISH.search(line):
        return [bare] if (bare := bare_entry(line)) else []
    text = _LINK.sub(r"\1", line).strip()
    parts = [bare_entry(p) for p in _ROW.split(text)]
    if text.startswith(("»", "›")):
        parts = [bare_entry(p) for p in re.split(r"[»›]", text)]
    return [p for p in parts if p]


def masked(text: str, names: frozenset[str], words: int | None = 3) -> str:
    """A line without figures, site names and addresses; of a role's line how it begins: notices vary at their ends."""
    text = text.lower()
    if "@" in text or "://" in text:
        text = _ADDRESSES.sub("@", text)
    found = ["0" if w.isdecimal() else _DIGITS.sub("0", w) if not w.isalpha() else w for w in _PARTS.findall(text)]
    return " ".join([w for w in found if w not in names][:words])


def _names(host: str) -> frozenset[str]:
    return frozenset(w for w in re.split(r"[^a-z]+", host.lower()) if len(w) > 2)


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _folded(text: str) -> str:
    """Lower case in which letters that patterns take for others, whatever their case, are those others."""
    return text.lower().replace("\u017f", "s").replace("i\u0307", "i")


def needed_words(items) -> frozenset[str] | None:
    """Of a parsed pattern, pieces of words of which each match holds one at least; None if there are no such pieces."""
    found: list[frozenset[str]] = []
    run = ""
    for op, value in [*items, (None, None)]:
        if op is re_constants.LITERAL and chr(value).isalnum() or op is re_constants.LITERAL and value in _MARKS:
            run += chr(value).lower()
            continue
        if run:
            found.append(frozenset([run]))
        run, inner = "", None
        if op is re_constants.SUBPATTERN:
            inner = needed_words(value[-1])
        elif op is re_constants.BRANCH:
            each = [needed_words(x) for x in value[1]]
            inner = frozenset().union(*each) if None not in each else None
        elif op in (re_constants.MAX_REPEAT, re_constants.MIN_REPEAT) and value[0] > 0:
            inner = needed_words(value[2])
        if inner:
            found.append(inner)
    return max(found, key=lambda words: (min(map(len, words)), -len(words)), default=None)


_MARKS = frozenset(map(ord, "©@()"))
#: Pieces of wording and the roles whose lines hold them: each line with a role holds one of its role's. Only lines that
#: do are matched. A role without pieces is always tried, and so are all where a link (its brackets go first) may join some.
_ROLE_HINTS: dict[str, set[str]] = {"](": set(ROLES)}
for _name, _pattern in ROLES.items():
    for _piece in needed_words(re_parser.parse(_pattern, re.I)) or [""]:
        _ROLE_HINTS.setdefault(_piece, set()).add(_name)


class _Hinted(dict[str, frozenset[str]]):
    """The roles that a word without blanks hints at; words are remembered up to a fixed number."""

    def __missing__(self, word: str) -> frozenset[str]:
        if len(self) > 500_000:
            self.clear()
        roles = frozenset().union(*(roles for piece, roles in _ROLE_HINTS.items() if piece in word))
        self[word] = roles
        return roles


_HINTED = _Hinted()


def hinted(line: str) -> list[str]:
    """The roles whose pieces a line holds, in their order: no other can be its role."""
    found = frozenset().union(*map(_HINTED.__getitem__, _folded(line).split()))
    return [name for name in ROLES if name in found] if found else []


def role_of(line: str, bare: str, among: Iterable[str] = ROLES) -> str | None:
    for name in among:
        if _ROLE[name].match(bare if name not in ("crumb", "page") else re.sub(r"\s+", " ", _LINK.sub(r"\1", line)).strip(" *_#")):
            return name
    return None


class Node:
    """A line of a page's tree."""

    __slots__ = ("block", "entries", "kind", "line", "role", "text")

    def __init__(self, line: int, block: int, kind: str, role: str | None, entries: list[str], text: str) -> None:
        self.line, self.block, self.kind, self.role, self.entries, self.text = line, block, kind, role, entries, text


def page_nodes(text: str, headings: list[str] | None) -> list[Node]:
    """The nodes of a page that could be furniture: blocks of short lines, rows, links, lines with a role and running text."""
    nodes: list[Node] = []
    lines = text.replace("\r\n", "\n").split("\n")
    path = [h for h in (headings or []) if h and h.strip()]
    openers = {" > ".join(path[k:]).strip() for k in range(len(path))} | {" > ".join(path[:k]).strip() for k in range(1, len(path) + 1)}
    fence, block, at_start, branch = None, 0, True, None
    blank_before = True
    for number, raw in enumerate(lines):
        line = raw.strip()
        run = _FENCE.match(raw)
        if fence is not None:
            if run and run.group(1) == fence:
                fence = None
            continue
        if not line:
            if not blank_before:
                block += 1
            blank_before = True
            continue
        fresh, blank_before = blank_before, False
        if run:
            fence, branch = run.group(1), None
            continue
        if at_start and line in openers:
            at_start = False
            continue
        at_start = False
        bare = bare_entry(line)
        heading = line.startswith("#")
        roles = hinted(line)
        role = role_of(line, bare, roles) if roles else None
        if heading:
            branch = None
            if role == "related":
                branch = number, block
                nodes.append(Node(number, block, "title", role, [bare], line))
            else:
                block += 1
            continue
        if line.startswith("|") and line.count("|") > 2:
            branch = None
            continue
        if role == "related":
            branch = number, block
            nodes.append(Node(number, block, "title", role, [bare], line))
            continue
        short = len(bare) <= 90 and not re.search(r"[.!?:;,。]$", line)
        if branch is not None and role is None:
            # the list under a related title: contiguous, or the next block if the title stands alone
            title_line, title_block = branch
            if short and (block == title_block or (fresh and block == title_block + 1 and all(not x.strip() for x in lines[title_line + 1 : number])) or nodes and nodes[-1].kind == "listed" and nodes[-1].block == block):
                nodes.append(Node(number, block, "listed", "related", [bare], line))
                continue
            branch = None
        if role is not None:
            nodes.append(Node(number, block, "line", role, [bare], line))
            continue
        entries = entries_of(line)
        if len(entries) >= 2 and all(_ROLE["button"].match(e) for e in entries):
            nodes.append(Node(number, block, "line", "button", entries, line))
            continue
        if len(entries) >= 2 and all(len(e) <= 40 for e in entries):
            nodes.append(Node(number, block, "row", None, entries, line))
        elif short and len(bare) <= 45 and len(bare.split()) <= WORDS:
            kind = "link" if _LINK.search(line) else "entry" if _MARKER.match(raw) else "plain"
            nodes.append(Node(number, block, kind, None, [bare], line))
        else:
            nodes.append(Node(number, block, "text", None, [], line))
        # short lines and running text are branches of their own, blank line or not
        if len(nodes) > 1 and nodes[-2].block == block and (nodes[-2].kind == "text") != (nodes[-1].kind == "text"):
            block += 1
            nodes[-1].block = block
    return nodes


def _signature(text: str) -> int:
    """A value that near copies of a page mostly share: the least hash of its long lines."""
    return min((_digest(x) for x in text.split("\n") if len(x) > 80), default=_digest(text))


NODES = "id string, host string, page long, line_no int, block int, kind string, role string, entry string, label boolean, sentence boolean"


def tree_nodes(chunks: DataFrame) -> DataFrame:
    """One row per node entry of every chunk of ``(id, kb_path, text, headings)``."""

    columns = [c.split()[0] for c in NODES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, kb_path, text, headings in zip(batch["id"], batch["kb_path"], batch["text"], batch["headings"]):
                if len(out) > 50_000:  # rows in memory at a time, whatever the pages hold
                    yield pd.DataFrame(out, columns=columns)
                    out = []
                host = (kb_path or "").split("/")[0]
                found = page_nodes(text, list(headings) if headings is not None else None)
                names, page = _names(host), _signature(text)
                out.append((id_, host, page, -1, -1, "page", None, None, False, False))
                for n in found:
                    if n.role is not None:
                        content = n.role if n.kind == "listed" else masked(n.text.split(":")[0] if n.role in ("page", "crumb") and ":" in n.text else (re.split(r"[»>›|/·]", n.text)[0] if n.role == "crumb" else n.text), names)
                        sentence = n.kind == "line" and len(n.text.split()) > WORDS and n.text[-1] in ".!?" and n.role != "copyright"
                        out.append((id_, host, page, n.line, n.block, n.kind, n.role, content, False, sentence))
                    elif n.kind == "text":
                        # marks alone have no words: such a line is its own content
                        content = masked(_LINK.sub(r"\1", n.text), names, None) or n.text
                        out.append((id_, host, page, n.line, n.block, n.kind, None, f"{_digest(content):x}", False, False))
                    else:
                        out.extend((id_, host, page, n.line, n.block, n.kind, None, e, e in LABELS, False) for e in n.entries)
            yield pd.DataFrame(out, columns=columns)

    return chunks.select("id", "kb_path", "text", "headings").mapInPandas(run, NODES)


def role_importance(nodes: DataFrame) -> DataFrame:
    """``(host, role, importance)``: entropy of the role's contents on the host over that of its occurrences, with all hosts' as prior."""
    per = nodes.where(F.col("role").isNotNull() & (F.col("kind") != "listed")).groupBy("host", "role", "entry").agg(F.count(F.lit(1)).alias("c"))
    n, weighed = F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s")
    entropy = F.when(F.col("n") > 1, 1 - F.col("s") / F.col("n") / F.log("n")).otherwise(F.lit(1.0))
    toward = lambda prior: (F.col("n") * entropy + PRIOR * prior) / (F.col("n") + PRIOR)
    wide = per.groupBy("role", "entry").agg(F.sum("c").alias("c")).groupBy("role").agg(n, weighed).select("role", toward(F.lit(0.0)).alias("wide"))
    return per.groupBy("host", "role").agg(n, weighed).join(F.broadcast(wide), "role").select("host", "role", toward(F.col("wide")).alias("importance"))


def entry_importance(nodes: DataFrame) -> DataFrame:
    """``(host, entry, importance)`` of entries that enough distinct pages of a host hold."""
    pages = nodes.where(F.col("kind") == "page").groupBy("host").agg(F.countDistinct("page").alias("m"))
    leaves = nodes.where(F.col("role").isNull() & F.col("entry").isNotNull()).select("host", "entry", "page").distinct()
    seen = leaves.groupBy("host", "entry").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= LEAST_SEEN)
    return seen.join(pages, "host").select("host", "entry", (1 - F.log("f") / F.log(F.greatest("m", F.lit(2)))).alias("importance"))


def furniture_lines(df: DataFrame, id_col: str = "id", path_col: str = "kb_path", text_col: str = "text", headings_col: str = "headings") -> DataFrame:
    """``(id, line_no)`` of every line that is not main body."""
    rows = df.select(F.col(id_col).alias("id"), F.col(path_col).alias("kb_path"), F.col(text_col).alias("text"), F.col(headings_col).alias("headings"))
    rows = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != ""))
    # equal ids carry equal texts: any row will do for the text, the least path names the host
    chunks = rows.groupBy("id").agg(F.min("kb_path").alias("kb_path"), F.first("text").alias("text"), F.first("headings", ignorenulls=True).alias("headings"))
    nodes = staged(tree_nodes(chunks), "nodes")
    roles = role_importance(nodes).where(F.col("importance") < ROLE_LOW).select("host", "role")
    # a sentence whose opening no other line of any page has is its page's own, whatever its wording
    own = nodes.where(F.col("role").isNotNull() & (F.col("kind") == "line")).groupBy("role", "entry").agg(F.count(F.lit(1)).alias("lines"), F.bool_and("sentence").alias("sentence"))
    own = own.where("sentence and lines = 1").select("role", "entry", F.lit(True).alias("sentence"))
    by_role = nodes.join(roles, ["host", "role"], "left_semi").join(own, ["role", "entry", "sentence"], "left_anti").select("id", "line_no")
    low = entry_importance(nodes)
    leaves = nodes.where(F.col("role").isNull() & (F.col("line_no") >= 0)).join(low, ["host", "entry"], "left")
    importance = F.when(F.col("label"), F.lit(0.0)).otherwise(F.coalesce("importance", F.lit(1.0)))
    lines = leaves.groupBy("id", "block", "line_no").agg(F.first("kind").alias("kind"), F.avg(importance).alias("importance"), F.count(F.lit(1)).alias("entries"))
    # a branch: the short lines of a block; rows and running text are branches of their own
    block = lines.groupBy("id", "block").agg(
        F.count(F.lit(1)).alias("lines"), F.sum((F.col("kind") == "text").cast("int")).alias("texts"), F.avg(F.when(F.col("kind") != "text", F.col("importance"))).alias("mean")
    )
    judged = lines.join(block, ["id", "block"])
    row = F.col("kind").isin("row", "text") & (F.col("importance") < LOW)
    whole = (F.col("texts") == 0) & (F.col("mean") < LOW)
    alone = (F.col("importance") < 0.25) & (F.col("kind").isin("link", "plain"))
    by_entry = judged.where(row | whole | alone).select("id", "line_no")
    return by_role.unionByName(by_entry).distinct()


def main_bodies(df: DataFrame, found: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, body)``: each chunk's text without its furniture lines; runs of blank lines become one."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull()).groupBy("id").agg(F.first("text", ignorenulls=True).alias("text"))
    drop = found.groupBy("id").agg(F.collect_set("line_no").alias("drop"))  # lines of one text
    lines = F.split(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")), "\n")
    kept = F.filter(lines, lambda x, k: ~F.coalesce(F.array_contains(F.col("drop"), k), F.lit(False)))
    body = F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n[ \t]*\n\s*\n", "\n\n"), r"^\s+|\s+$", "")
    return texts.join(drop, "id", "left").select("id", body.alias("body"))
