"""Subject areas of documents, from weak labels of their sentences.

Method: labelling functions vote on every sentence - the *seed lexicon* of the labelled examples, the *lexicon* that
the corpus adds to it, the *section* the sentence stands in (most votes of the other sentences of its paragraph, else
its heading, the title, the other paragraphs), the *address* (words of the host and path of the source and of the URLs
in the text) and the *source* as a whole string. A latent-variable model learns how often each function abstains and
how often it is right, without labels, from the counts of all vote patterns of the corpus. A document has the subjects
whose posterior probabilities add up to at least a quarter of its sentences, if its votes agree more than chance would.

Texts are read once: what the functions need of them, word hashes and places, is a table in the shared folder.

Sizes: features are hashed to ``2 ** BITS`` counters, sources to ``SOURCES``, words of addresses to ``ADDRESSES``;
patterns are at most ``13 ** 5``. Everything that reaches the driver or is broadcast is one of these tables, and is
counted before it does. Statistics cover every sentence of every document.

Defined results
- null and blank texts, and texts without a sentence on a listed subject, have no row;
- menus, notices and footers (lines with a role on a page, lines that are no sentences) are not counted;
- a document may have up to four subjects; repeated documents each have theirs;
- with no examples nothing is labelled; texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.boilerplate import bare_entry, hinted, role_of
from loam.session import bounded_arrow, bounded_rows, spread, staged

BITS, SOURCES, ADDRESSES, SHARE = 18, 4096, 16384, 0.25
_SIZE = 1 << BITS
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_TOKEN = re.compile(r"[^\W\d_]+|\n")
_CJK = re.compile(r"[一-鿿぀-ヿ가-힯]")
_SPLIT = re.compile(r"(?<=[.!?。])\s+")
_ENDS = re.compile(r"[.!?。！？…][\"'”»)*_]*$")
_LEAD = re.compile(r"^(?:#{1,6}\s+|[-*+•>]\s+|\d{1,3}[.)]\s+|\*\*)?(?:(?:user|assistant|system|q|a|question|answer|frage|antwort|pregunta|respuesta|réponse)\s*:\s*)?", re.I)

_ADDRESS = re.compile(r"[a-z][a-z0-9+.-]*://[^\s<>\"'()\[\]]+", re.I)
_ADDRESS_PARTS = frozenset("www http https com org net html htm php pdf index".split())
_ROWS = 4000  # documents that a worker looks at together
FUNCTIONS = ("seed", "lexicon", "section", "address", "source")


def sentences_of(text: str) -> tuple[list[str], list[int], list[int], list[str]]:
    """Sentences of a document's own text, the section and paragraph of each, and the heading of each section."""
    sentences, sections, paragraphs, headings = [], [], [], [""]
    paragraph, blank = 0, True
    for raw in text.split("\n"):
        line = raw.strip()
        if not line:
            paragraph += not blank
            blank = True
            continue
        blank = False
        ends = line[-1] in ".!?。！？…" or _ENDS.search(line) is not None
        if line[0] == "#" and not ends:
            headings.append(line)
            continue
        if not ends and (len(line) < 60 or ". " not in line):
            continue
        roles = hinted(line)
        if roles and role_of(line, bare_entry(line), roles):
            continue
        if line[0] in "#-*+•>0123456789" or ":" in line[:20]:
            line = _LEAD.sub("", line)
        if "。" in line:
            line = line.replace("。", "。 ")
        for sentence in _SPLIT.split(line):
            if len(sentence) > 3:
                sentences.append(sentence)
                sections.append(len(headings) - 1)
                paragraphs.append(paragraph)
    return sentences, sections, paragraphs, headings


class Words:
    """Hashes of the words of sentences, 0 after each sentence; hashes are remembered up to a fixed number of words."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {"\n": 0}

    def _codes(self, words: list[str]) -> np.ndarray:
        if len(self.seen) > 500_000:
            self.seen = {"\n": 0}
        seen = self.seen
        for word in set(words).difference(seen):
            seen[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) & 0xFFFFFFFF | 1
        return np.fromiter(map(seen.__getitem__, words), np.uint32, len(words))

    def __call__(self, sentences: list[str]) -> np.ndarray:
        parts = [np.empty(0, np.uint32)]
        for k in range(0, len(sentences), 4096):  # one pass of the pattern over many sentences; a line feed ends each
            text = "\n".join([*sentences[k : k + 4096], ""]).lower()
            if not text.isascii() and _CJK.search(text):
                text = _CJK.sub(r" \g<0> ", text)
            parts.append(self._codes(_TOKEN.findall(text)))
        return np.concatenate(parts)


def features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, bucket)``: hashed unigrams and bigrams of sentences, each with its sentence."""
    h = codes.astype(np.uint64)
    ends = h == 0
    owner = np.cumsum(ends) - ends
    h, owner = h[~ends], owner[~ends]
    pair = (h[:-1] * _M[0] + h[1:] * _M[1]) * _M[0]
    inside = owner[1:] == owner[:-1]
    buckets = np.concatenate((h * _M[0], pair[inside])) >> np.uint64(64 - BITS)
    return np.concatenate((owner, owner[1:][inside])), buckets.astype(np.int32)


def address_words(source: str | None, text: str) -> list[str]:
    """Words of the hosts and paths of a document's source and of the URLs in its text, each once."""
    addresses = [source or ""]
    if "://" in text:
        addresses += _ADDRESS.findall(text)
    return list(dict.fromkeys(w for a in addresses for w in re.findall(r"[^\W\d_]{3,}", a.lower()) if w not in _ADDRESS_PARTS))


READ = "doc_id long, source int, words binary, section binary, paragraph binary, heads binary, address binary"


def read_texts(docs: DataFrame) -> DataFrame:
    """What the functions need of each text: word hashes of its sentences with their sections and paragraphs, of the title and headings, and slots of address words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Words()
        for whole in batches:
            for batch in _parts(whole):
                sentences, heads, section, paragraph, count, head_count, address, source = [], [], [], [], [], [], [], []
                for text, src, title in zip(batch["text"], batch["source"], batch["title"]):
                    own, sec, par, headings = sentences_of(text.replace("\r\n", "\n"))
                    headings[0] = title or (headings[1] if len(headings) > 1 else "")
                    sentences += own
                    heads += headings
                    section += sec
                    paragraph += par
                    count.append(len(own))
                    head_count.append(len(headings))
                    address.append(np.array([_slot_of(w, ADDRESSES) for w in address_words(src, text)], np.int32).tobytes())
                    source.append(_slot_of(src or "", SOURCES))
                codes, head_codes = make(sentences), make([h.replace("\n", " ") for h in heads])
                at = np.concatenate(([0], np.cumsum(count)))
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"], "source": np.array(source, np.int32), "words": _cut(codes, at),
                        "section": _split(np.array(section, np.int32), at), "paragraph": _split(np.array(paragraph, np.int32), at),
                        "heads": _cut(head_codes, np.concatenate(([0], np.cumsum(head_count)))), "address": pd.Series(address, dtype=object, index=batch.index),
                    },
                    index=batch.index,
                )

    return spread(docs.select("doc_id", "text", "source", "title")).mapInPandas(run, READ)


def _parts(batch: pd.DataFrame, chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """A batch in parts of some documents and about so many characters: a few very long texts are parts of their own."""
    if len(batch):
        part = np.cumsum(batch["text"].str.len().to_numpy()) // chars + np.arange(len(batch)) // _ROWS
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(batch)]
        for a, b in zip(edges, edges[1:]):
            yield batch.iloc[a:b]


def _split(values: np.ndarray, at: np.ndarray) -> list[bytes]:
    return [values[a:b].tobytes() for a, b in zip(at, at[1:])]


def _cut(codes: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Codes of many sentences by document; ``at`` are the documents' first sentences."""
    ends = np.concatenate(([0], np.flatnonzero(codes == 0) + 1))
    return _split(codes, ends[at])


def _joined(column: pd.Series, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def _sizes(column: pd.Series) -> np.ndarray:
    return np.fromiter(map(len, column), np.int64, len(column)) // 4


@dataclass
class Lexicon:
    """Log-odds of each subject by feature; features that tell nothing are left out."""

    buckets: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, buckets: np.ndarray, counts: np.ndarray, least: float, purity: float, weight: float = 20) -> Lexicon:
        """From ``counts[feature, subject]``: features seen ``least`` times, with at least ``purity`` of it on one subject.

        ``weight`` sightings of the prior are added, so that few sightings say little.
        """
        total = counts.sum(axis=1)
        prior = np.maximum(counts.sum(axis=0), 1) / max(1.0, counts.sum())
        share = (counts + weight * prior) / (total + weight)[:, None]
        lift = counts / np.maximum(counts.sum(axis=0), 1)
        lift /= np.maximum(lift.sum(axis=1), 1e-12)[:, None]
        good = (total >= least) & (lift.max(axis=1, initial=0) >= purity)
        return cls(buckets[good], np.log(np.maximum(share[good] / prior, 0.05)).astype(np.float32))

    def table(self) -> np.ndarray:
        index = np.full(_SIZE, -1, np.int32)
        index[self.buckets] = np.arange(len(self.buckets), dtype=np.int32)
        return index


class _Voter:
    def __init__(self, lexicon: Lexicon, subjects: int) -> None:
        self.index, self.weights, self.subjects = lexicon.table(), lexicon.weights, subjects

    def scores(self, owner: np.ndarray, bucket: np.ndarray, sentences: int) -> np.ndarray:
        at = self.index[bucket]
        known = at >= 0
        out = np.zeros((sentences, self.subjects), np.float32)
        rows, own = self.weights[at[known]], owner[known]
        for s in range(self.subjects):
            out[:, s] = np.bincount(own, rows[:, s], minlength=sentences)
        return out


def votes(scores: np.ndarray, least: float, gap: float = 0.7) -> np.ndarray:
    """The best subject of each row from 1, or 0 where the evidence is thin or divided."""
    if not len(scores):
        return np.zeros(0, np.int8)
    order = np.partition(scores, -2, axis=1) if scores.shape[1] > 1 else np.column_stack((np.full(len(scores), -9e9), scores[:, 0]))
    best = scores.argmax(axis=1) + 1
    return np.where((order[:, -1] >= least) & (order[:, -1] - order[:, -2] >= gap), best, 0).astype(np.int8)


def seed_lexicon(examples: list[tuple[int, str]], subjects: int) -> Lexicon:
    """From labelled passages (subject from 0, text)."""
    owner, bucket = features(Words()([text.replace("\n", " ") for _, text in examples]))
    of = np.array([s for s, _ in examples], np.int64)
    buckets, back = np.unique(bucket, return_inverse=True)
    counts = np.zeros((len(buckets), subjects))
    # presence per passage: a word repeated in one passage is one observation
    seen = np.unique(np.column_stack((owner, back)), axis=0) if len(bucket) else np.zeros((0, 2), np.int64)
    np.add.at(counts, (seen[:, 1], of[seen[:, 0]]), 1)
    return Lexicon.of(buckets, counts, least=1, purity=0.75, weight=1)


def _slot_of(word: str, slots: int) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % slots


def _others(scores: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each sentence the mean scores of the others in its group."""
    groups, back = np.unique(group, return_inverse=True)
    size = np.bincount(back)[back]
    total = np.column_stack([np.bincount(back, scores[:, s], minlength=len(groups)) for s in range(scores.shape[1])])[back]
    return (total - scores) / np.maximum(size - 1, 1)[:, None]


def _labels(scores: np.ndarray, doc: np.ndarray, paragraph: np.ndarray) -> np.ndarray:
    """The label of each sentence by the rest of its paragraph and document, not by itself.

    The few examples tie phrases that every subject uses to one of them by chance; such phrases vouch for each other
    within a sentence, but stand in documents on all subjects. So a sentence's own words learn from its surroundings.
    """
    if not len(doc):
        return np.zeros(0, np.int64)
    return votes((_others(scores, paragraph) + _others(scores, doc)).astype(np.float32), least=0.5, gap=0.5).astype(np.int64)


def corpus_counts(texts: DataFrame, seeds, subjects: int) -> DataFrame:
    """``(slot, subject, n)``: sentences that the seeds label, by feature; sources and address words follow the features' slots."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voter = _Voter(seeds.value, subjects)
        width = _SIZE + SOURCES + ADDRESSES
        total = np.zeros((subjects + 1) * width, np.int64)
        for whole in batches:
            for start in range(0, len(whole), _ROWS):
                batch = whole.iloc[start : start + _ROWS]
                size = _sizes(batch["paragraph"])
                doc = np.repeat(np.arange(len(batch)), size)
                owner, bucket = features(_joined(batch["words"], "<u4"))
                label = _labels(voter.scores(owner, bucket, len(doc)), doc, (doc << 32) + _joined(batch["paragraph"]))
                base = label * width
                cells = [base[owner] + bucket, base + batch["source"].to_numpy(np.int64)[doc] + _SIZE]
                # every word of a document's addresses stands at each of its sentences
                words, each = _joined(batch["address"]), _sizes(batch["address"])
                of = np.repeat(np.arange(len(doc)), each[doc])
                first = np.concatenate(([0], np.cumsum(each)))[:-1][doc]
                place = np.arange(len(of)) - np.repeat(np.cumsum(each[doc]) - each[doc], each[doc])
                cells.append(base[of] + words[first[of] + place] + _SIZE + SOURCES)
                total += np.bincount(np.concatenate(cells), minlength=len(total))
        used = np.flatnonzero(total)
        yield pd.DataFrame({"slot": (used % width).astype(np.int32), "subject": (used // width).astype(np.int32), "n": total[used]})

    return texts.select("words", "paragraph", "source", "address").mapInPandas(run, "slot int, subject int, n long")


def learned(counts: DataFrame, subjects: int) -> tuple[Lexicon, np.ndarray, Lexicon]:
    """The corpus lexicon, each source slot's vote and the lexicon of addresses; only informative features reach the driver, at most one row each."""
    total = counts.groupBy("slot", "subject").agg(F.sum("n").alias("n"))
    wide = total.where(F.col("subject") > 0).groupBy("slot").agg(*[F.sum(F.when(F.col("subject") == s, F.col("n")).otherwise(0)).alias(f"s{s}") for s in range(1, subjects + 1)])
    cells = [F.col(f"s{s}") for s in range(1, subjects + 1)]
    every = sum(cells[1:], cells[0])
    telling = (F.greatest(*cells) if subjects > 1 else cells[0]) >= F.lit(0.4) * every
    table = bounded_arrow(wide.where((F.col("slot") >= _SIZE) | ((every >= 5) & telling)), _SIZE + SOURCES + ADDRESSES, "features")
    slot = table["slot"].to_numpy()
    n = np.column_stack([table[f"s{s}"].to_numpy() for s in range(1, subjects + 1)]).astype(np.float64) if len(slot) else np.zeros((0, subjects))
    words, addresses = slot < _SIZE, slot >= _SIZE + SOURCES
    lexicon = Lexicon.of(slot[words], n[words], least=5, purity=0.5)
    source = np.zeros(SOURCES, np.int8)
    named = ~words & ~addresses
    own = n[named]
    clear = (own.max(axis=1, initial=0) >= 0.5 * own.sum(axis=1)) & (own.sum(axis=1) >= 20)
    source[slot[named][clear] - _SIZE] = own[clear].argmax(axis=1) + 1 if clear.any() else 0
    return lexicon, source, Lexicon.of(slot[addresses] - _SIZE - SOURCES, n[addresses], least=20, purity=0.5)


def _majority(group: np.ndarray, vote: np.ndarray, subjects: int, without: np.ndarray | None = None) -> np.ndarray:
    """For each sentence the majority vote of the others in its group, or of those outside the smaller group ``without``; 0 where there is none."""

    def table(of: np.ndarray) -> np.ndarray:
        groups, back = np.unique(of, return_inverse=True)
        return np.bincount(back * (subjects + 1) + vote, minlength=len(groups) * (subjects + 1)).reshape(len(groups), subjects + 1)[back]

    others = table(group)
    if without is None:
        others[np.arange(len(vote)), vote] -= 1
    else:
        others -= table(without)
    others[:, 0] = 0
    best = others.argmax(axis=1)
    return np.where(others.max(axis=1, initial=0) * 2 > others.sum(axis=1), best, 0)


VOTES = "doc_id long, n int, pattern array<int>, times array<int>"


def document_votes(texts: DataFrame, seeds, lexicon, sources, addresses, subjects: int) -> DataFrame:
    """One row per document: its number of sentences, and how often each pattern of votes occurs in it."""
    base = subjects + 1

    def votes_of(batch: pd.DataFrame, seed: _Voter, lex: _Voter, by_address: np.ndarray, source_of: np.ndarray) -> pd.DataFrame:
        size = _sizes(batch["paragraph"])
        doc = np.repeat(np.arange(len(batch)), size)
        n = len(doc)
        owner, bucket = features(_joined(batch["words"], "<u4"))
        by_lexicon = votes(lex.scores(owner, bucket, n), least=1.2).astype(np.int64)
        by_seed = votes(seed.scores(owner, bucket, n), least=1.5).astype(np.int64)
        paragraph = (doc << 32) + _joined(batch["paragraph"])
        codes = _joined(batch["heads"], "<u4")
        ends = np.concatenate(([0], np.cumsum(codes == 0)))
        first_head = ends[np.concatenate(([0], np.cumsum(_sizes(batch["heads"]))))[:-1]]  # of each document: its title
        heads = votes(lex.scores(*features(codes), int(ends[-1])), least=1.2).astype(np.int64)
        title, section = first_head[doc], _joined(batch["section"])
        by_section = _majority(paragraph, by_lexicon, subjects)
        for other in (np.where(section > 0, heads[title + section], 0), heads[title], _majority(doc, by_lexicon, subjects, paragraph)) if n else ():
            by_section = np.where(by_section == 0, other, by_section)
        code = np.zeros(n, np.int64)
        for column in (by_seed, by_lexicon, by_section, by_address[doc], source_of[batch["source"].to_numpy()][doc]):
            code = code * base + column
        keys, times = np.unique(doc * base**5 + code, return_counts=True)
        edges = np.searchsorted(keys // base**5, np.arange(len(batch) + 1))
        codes, times = (keys % base**5).astype(np.int32), times.astype(np.int32)
        cut = lambda x: pd.Series([x[a:b] for a, b in zip(edges, edges[1:])], dtype=object, index=batch.index)
        return pd.DataFrame({"doc_id": batch["doc_id"], "n": size.astype(np.int32), "pattern": cut(codes), "times": cut(times)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seed, lex, address = _Voter(seeds.value, subjects), _Voter(lexicon.value, subjects), _Voter(addresses.value, subjects)
        for whole in batches:
            for start in range(0, len(whole), _ROWS):
                batch = whole.iloc[start : start + _ROWS]
                of = np.repeat(np.arange(len(batch)), _sizes(batch["address"]))
                by_address = votes(address.scores(of, _joined(batch["address"]), len(batch)), least=1.2).astype(np.int64)
                yield votes_of(batch, seed, lex, by_address, sources.value)

    return texts.mapInPandas(run, VOTES)


def latent_model(patterns: np.ndarray, counts: np.ndarray, subjects: int, rounds: int = 40) -> tuple[np.ndarray, dict[str, tuple[float, float]]]:
    """Posterior of every pattern over (none, subjects), and each function's learned (coverage, accuracy).

    A sentence on subject y gets from function j no vote with probability 1 - c_j, y with c_j a_j, and another with the
    rest: evenly from the lexicons, all on one from the functions that look at where it stands. A sentence on none gets
    votes by chance, b_j: evenly from the lexicons, as often as each subject is voted for overall from the others.
    """
    base = subjects + 1
    vote = np.stack([(patterns // base ** (4 - j)) % base for j in range(5)])
    weight = counts / max(1, counts.sum())
    cover, right, chance = np.array([0.6, 0.95, 0.95, 0.3, 0.3]), np.array([0.95, 0.95, 0.9, 0.5, 0.5]), np.array([0.05, 0.03, 0.5, 0.5, 0.5])
    prior = np.full(base, 0.9 / subjects)
    prior[0] = 0.1
    overall = []
    for j in range(5):
        voted = np.bincount(vote[j], weight, minlength=base)
        voted[0] = 0
        overall.append((np.full(base, 1 / subjects) if j < 2 else voted / max(1e-12, voted.sum()))[vote[j]])
    post = np.zeros((len(patterns), base))
    for _ in range(rounds):
        for y in range(base):
            p = np.full(len(patterns), prior[y])
            for j in range(5):
                if y == 0:
                    p *= np.where(vote[j] == 0, 1 - chance[j], chance[j] * overall[j])
                    continue
                # what a lexicon errs to is chance; where a sentence stands errs to the document's other subject
                wrong = cover[j] * (1 - right[j]) / (max(1, subjects - 1) if j < 2 else 1)
                p *= np.where(vote[j] == 0, 1 - cover[j], np.where(vote[j] == y, cover[j] * right[j], wrong))
            post[:, y] = p
        post /= np.maximum(post.sum(axis=1), 1e-300)[:, None]
        mass = post * weight[:, None]
        prior = np.clip(mass.sum(axis=0), 1e-4, None)
        prior /= prior.sum()
        on = max(1e-12, mass[:, 1:].sum())
        for j in range(5):
            voted = mass[:, 1:][vote[j] > 0].sum()
            agreed = mass[np.arange(len(patterns)), vote[j]][vote[j] > 0].sum()
            cover[j] = np.clip(voted / on, 0.02, 0.995)
            right[j] = np.clip(agreed / max(1e-12, voted), 1 / base, 0.995)
            chance[j] = np.clip(mass[:, 0][vote[j] > 0].sum() / max(1e-12, mass[:, 0].sum()), 0.002, 0.6 if j < 2 else 0.995)
    return post, {name: (float(cover[j]), float(right[j])) for j, name in enumerate(FUNCTIONS)}


def on_subjects(doc: np.ndarray, codes: np.ndarray, times: np.ndarray, docs: int, subjects: int) -> np.ndarray:
    """Whether each document is on subjects at all: naming them must say its votes more briefly than chance does.

    A document's V votes are those of the corpus lexicon, of the seeds where it is silent. By chance each costs log S; with K
    of S subjects named, the choice costs log C(S, K), their shares log(V) / 4 each but one, and the votes their entropy.
    Texts on nothing have votes on one subject here and another there. Without any votes the sentences alone decide.
    """
    if subjects < 2:
        return np.ones(docs, bool)
    base = subjects + 1
    lexicon = codes // base**3 % base
    vote = np.where(lexicon > 0, lexicon, codes // base**4)
    cells = np.bincount(doc * base + vote, times, minlength=docs * base).reshape(docs, base)[:, 1:]
    cast = cells.sum(axis=1)
    shares = np.where(cells > 0, cells, 1) / np.where(cells > 0, np.maximum(cast, 1)[:, None], 1)
    named = (cells > 0).sum(axis=1)
    choice = np.array([math.log(math.comb(subjects, k)) for k in range(base)])[named] + np.maximum(named - 1, 0) * np.log(np.maximum(cast, 1)) / 4
    gain = cast * np.log(subjects) + (cells * np.log(shares)).sum(axis=1) - choice
    return (gain > 1e-9) | (cast == 0)


def document_subjects(docs: DataFrame, examples: DataFrame, areas: DataFrame, share: float = SHARE) -> DataFrame:
    """``(doc_id, subject, share)`` of every document and subject that takes up at least ``share`` of its sentences.

    ``areas`` and ``examples`` are the fixed reference tables (checked to be under 10,000 rows).
    """
    spark = docs.sparkSession
    names = sorted({r["subject"] for r in bounded_rows(areas.select("subject").where(F.col("subject").isNotNull()), 10_000, "subjects")})
    place = {name: k for k, name in enumerate(names)}
    passages = [(place[r["subject"]], r["text"]) for r in bounded_rows(examples.select("subject", "text"), 10_000, "examples") if r["subject"] in place and r["text"]]
    rows = docs.select("doc_id", "text", "source", "title").where(F.col("text").isNotNull() & (F.trim("text") != ""))
    subjects = max(1, len(names))
    cast = spark.sparkContext.broadcast
    seeds = cast(seed_lexicon(passages, subjects))
    texts = staged(read_texts(rows), "texts")
    lexicon, source, addresses = learned(corpus_counts(texts, seeds, subjects), subjects)
    voted = staged(document_votes(texts, seeds, cast(lexicon), cast(source), cast(addresses), subjects), "votes")
    both = voted.select(F.explode(F.arrays_zip("pattern", "times")).alias("x"))
    table = bounded_arrow(both.groupBy(F.col("x.pattern").alias("pattern")).agg(F.sum("x.times").alias("n")), (subjects + 1) ** 5, "patterns")  # in fact few
    patterns, counts = table["pattern"].to_numpy().astype(np.int64), table["n"].to_numpy().astype(np.float64)
    post, _ = latent_model(patterns, counts, subjects)
    order = np.argsort(patterns)
    held = cast((patterns[order], post[order].astype(np.float32), names))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, posterior, subject_names = held.value
        for batch in batches:
            size = np.fromiter(map(len, batch["pattern"]), np.int64, len(batch))
            if not size.sum():
                continue
            codes = np.concatenate(batch["pattern"].to_numpy()).astype(np.int64)
            times = np.concatenate(batch["times"].to_numpy())
            mass = posterior[np.searchsorted(known, codes)][:, 1:] * times[:, None]
            doc = np.repeat(np.arange(len(batch)), size)
            total = np.column_stack([np.bincount(doc, mass[:, s], minlength=len(batch)) for s in range(mass.shape[1])])
            part = total / np.maximum(batch["n"].to_numpy(), 1)[:, None]
            at, s = np.nonzero((part >= share - 1e-6) & on_subjects(doc, codes, times, len(batch), subjects)[:, None])
            keep = s < len(subject_names)
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[at[keep]], "subject": pd.Series([subject_names[k] for k in s[keep]], dtype=object), "share": np.round(part[at[keep], s[keep]], 4)})

    return voted.mapInPandas(assign, "doc_id long, subject string, share double")


def composition(found: DataFrame) -> DataFrame:
    """Documents and mean share by subject: what the corpus is about."""
    return found.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("share"), 6).alias("mean_share"))
