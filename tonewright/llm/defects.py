"""Broken prompt and response pairs: empty, refused, cut, copied and foreign-language answers.

A multi-label linear classifier over hashed word n-grams of the answer and features of the pair is trained on
answers broken on purpose: cut, copied with small changes, swapped with answers in another language, refused and
emptied. Its thresholds are calibrated on held-out broken answers. What the definitions of a copy, an empty answer and
a foreign answer say of a pair is among the features, and what the classifier finds must also meet them.

Training reads a sample of at most ``SAMPLE`` pairs, those of the smallest hashes; every pair is scored, whole. The features
of a batch are computed side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.llm.folding import LOOK_ALIKES, fold
from tonewright.llm.language import ODDS, ODDS_A_LETTER, Languages, fit_languages
from tonewright.llm.truncation import _CLOSED, _UNIT, _WORD, core_of, find_truncated
from tonewright.session import cut

#: The defects, the first that applies being the one reported.
DEFECTS = ("empty", "refusal", "truncated", "copy", "other_language")
SAMPLE = 6_000
WORDS = 1 << 17
#: Share of held-out broken answers that a threshold must let through.
KEPT = 0.998
#: Most rows and most bytes of text whose features are computed at once (a longer pair stands alone), and most words remembered.
ROWS, BYTES, REMEMBERED = 4096, 8 << 20, 400_000
#: Share of changed words of a copy.
CHANGED = 0.1
#: What stands in for an answer.
STAND_INS = {"none", "null", "nan", "n/a", "na", "n a", "nil", "undefined", "нет ответа", "пусто", "нет", "без ответа", "no answer", "empty", "ответ отсутствует", "not available"}
#: Parts of refusals, by language: openings, cores with a verb and an object, verbs, objects, endings.
REFUSALS = {
    "ru": (
        ["", "К сожалению, ", "Извините, но ", "Простите, ", "Прошу прощения: ", "Сожалею, но ", "Увы, ", "Боюсь, что ", "Как языковая модель, ",
         "Как искусственный интеллект, ", "Спасибо за запрос, однако "],
        ["я не могу {v} {o}", "я не буду {v} {o}", "я не стану {v} {o}", "мне нельзя {v} {o}", "мне запрещено {v} {o}", "мне не положено {v} {o}",
         "у меня нет возможности {v} {o}", "не получится {v} {o}", "не в моих силах {v} {o}", "я отказываюсь {v} {o}", "я не возьмусь {v} {o}",
         "вынужден отказаться {v} {o}", "я не вправе {v} {o}", "считаю неуместным {v} {o}", "ваш запрос отклонён", "ваша просьба отклонена",
         "запрос остановлен фильтром безопасности", "такие тексты я не обрабатываю", "с этим заданием помочь не могу", "с этой просьбой помочь не сумею",
         "обработка такого текста не поддерживается", "выполнение задания прекращено", "без согласия автора текст не меняю",
         "эта тема слишком чувствительна, чтобы менять стиль", "на эту просьбу отвечу отказом", "этот текст оставлю без изменений", "стилизации не будет"],
        ["переписать", "пересказать", "перефразировать", "стилизовать", "изменить", "переделать", "обработать", "выполнить", "перевести"],
        ["этот текст", "данный фрагмент", "ваш отрывок", "такой материал", "этот абзац", "подобный рассказ", "присланный пример", "этот запрос"],
        [".", ", поскольку это противоречит правилам.", ": запрос нарушает политику использования.", ", так как у меня нет нужных сведений.",
         ". Попробуйте прислать другой текст.", ". Могу предложить краткий пересказ.", ". Уточните, пожалуйста, задачу.", ". Если хотите, я объясню причину.",
         ". Номер обращения: 12345."],
    ),
    "uk": (
        ["", "На жаль, ", "Вибачте, але ", "Перепрошую, "],
        ["я не можу {v} {o}", "мені заборонено {v} {o}", "я відмовляюся {v} {o}", "ваш запит відхилено"],
        ["переписати", "переказати", "змінити", "стилізувати"], ["цей текст", "такий уривок", "цей запит"],
        [".", ", бо це суперечить правилам.", ". Спробуйте надіслати інший текст."],
    ),
    "en": (
        ["", "Sorry, but ", "I’m sorry, but ", "I apologize, but ", "Unfortunately, ", "As an AI assistant, ", "As a language model, "],
        ["I cannot {v} {o}", "I can’t {v} {o}", "I am unable to {v} {o}", "I must decline to {v} {o}", "I won’t {v} {o}", "I am not able to help with that request",
         "I refuse to {v} {o}", "your request was declined", "I am unable to help with that request"],
        ["rewrite", "paraphrase", "restyle", "change", "complete", "process"], ["this text", "this passage", "the fragment", "that request", "such content"],
        [".", " as it goes against my guidelines.", " without more context.", " in the requested style.", ". Please try another text."],
    ),
    "de": (
        ["", "Leider ", "Es tut mir leid, aber "], ["kann ich {o} nicht {v}", "darf ich {o} nicht {v}", "muss ich es ablehnen, {o} zu {v}"],
        ["umschreiben", "bearbeiten", "ändern"], ["diesen Text", "diese Anfrage", "diesen Abschnitt"], [".", ", da es gegen die Richtlinien verstößt."],
    ),
    "fr": (
        ["", "Désolé, mais ", "Malheureusement, "], ["je ne peux pas {v} {o}", "je refuse de {v} {o}", "il m’est impossible de {v} {o}"],
        ["réécrire", "modifier", "reformuler"], ["ce texte", "ce passage", "cette demande"], [".", ", car cela va à l’encontre des règles."],
    ),
}
_TABLE = str.maketrans(LOOK_ALIKES)
_TAG = re.compile(r"</?[^<>\s]{1,60}>|\[/?(?:отказ|inst|pad|unk|s)\]", re.I)
_QUOTED = re.compile(r"«[^»]*»|“[^”]*”|\"[^\"]*\"|(?:^|(?<=[.!?…]\s)|\n)\s*[—–][^—–]*[—–]")
#: Features of a pair, after the hashed words.
PAIR = ("bias", "no words", "few words", "shared", "covered", "shorter", "longer", "latin", "cyrillic", "script differs", "open end", "mark", "quoted", "tag", "language",
        "nothing", "copy", "foreign", "foreign share")


def words_of_text(text: str) -> list[str]:
    """Folded words, style tags aside."""
    return _WORD.findall(fold(_TAG.sub(" ", text) if "<" in text or "[" in text else text))


def is_empty(answer: str | None) -> bool:
    """No answer: missing, blank, or only marks, tags or a stand-in."""
    if answer is None:
        return True
    rest = _TAG.sub(" ", answer)
    words = _WORD.findall(fold(rest))
    return not words or (len(words) <= 3 and (" ".join(words) in STAND_INS or fold(rest).strip(" .!-—()[]<>\"'«»") in STAND_INS))


def distance_within(a: list, b: list, most: int) -> bool:
    """Whether the edit distance of two lists is at most ``most``, by the furthest place of each diagonal for 0, 1, ... edits.

    The work grows with the square of the distance, not with the length.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False

    def run(i: int, j: int) -> int:
        while i < n and j < m and a[i] == b[j]:
            i += 1
            j += 1
        return i

    low = -2 - n
    reach = {0: run(0, 0)}  # diagonal j - i -> how far in a
    for edits in range(most + 1):
        if reach.get(m - n, low) >= n:
            return True
        new = {}
        for k in range(max(-edits - 1, -n), min(edits + 1, m) + 1):
            i = min(max(reach.get(k, low) + 1, reach.get(k + 1, low) + 1, reach.get(k - 1, low)), n, m - k)
            if i >= 0 and i + k >= 0:
                new[k] = run(i, i + k)
        reach = new
    return False


class Lexicon(dict):
    """Numbers of folded words, with what is known of each: code (alike for words written alike), letters, Latin letters,
    likelihoods by language."""

    def __init__(self, languages: Languages):
        super().__init__()
        self.languages = languages
        self.lists: list[list] = [[], [], [], []]
        self.arrays = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros((0, languages.width))]

    def __missing__(self, word: str) -> int:
        import zlib

        i = self[word] = len(self)
        code = zlib.crc32(word.translate(_TABLE).encode()) & 0x7FFFFFFF
        for known, value in zip(self.lists, (code, float(len(word)), float(len(word)) if word[0] < "ɐ" else 0.0, self.languages.row(word))):
            known.append(value)
        return i

    def of(self, text: str) -> list[int]:
        return list(map(self.__getitem__, _WORD.findall(text)))

    def tables(self) -> list[np.ndarray]:
        if self.lists[0]:
            self.arrays = [np.concatenate([a, np.array(x, dtype=a.dtype).reshape(-1, *a.shape[1:])]) for a, x in zip(self.arrays, self.lists)]
            self.lists = [[], [], [], []]
        return self.arrays

    def forget(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()
            self.__init__(self.languages)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of ``sizes`` rows of ``values``."""
    out = np.zeros((len(sizes), *values.shape[1:]), dtype=values.dtype)
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some], axis=0)
    return out


@dataclass
class Features:
    """Features of pairs: those of PAIR, places of the words and word pairs of each answer among the weights, and what the
    exact definitions say."""

    pair: np.ndarray
    places: np.ndarray
    sizes: np.ndarray
    nothing: np.ndarray
    copy: np.ndarray
    foreign: np.ndarray

    def grams(self) -> list[np.ndarray]:
        return np.split(self.places, np.cumsum(self.sizes)[:-1])


def features(texts: list[str | None], answers: list[str | None], lexicon: Lexicon) -> Features:
    """The features of a batch of pairs."""
    plain = lambda v: fold(_TAG.sub(" ", v) if "<" in v or "[" in v else v)
    which: dict[str, int] = {}
    of_text = np.array([which.setdefault(t or "", len(which)) for t in texts], dtype=np.int64)
    text_ids = [lexicon.of(plain(t)) for t in which]
    units: list[list[int]] = []
    unit_row: list[int] = []
    answer_ids: list[list[int]] = []
    ends = np.zeros((len(answers), 4))
    for i, answer in enumerate(answers):
        ids: list[int] = []
        if answer:
            for unit in plain(_UNIT.sub("\0", answer)).split("\0"):
                if found := lexicon.of(unit):
                    units.append(found)
                    unit_row.append(i)
                    ids += found
            core, mark = core_of(answer)
            ends[i] = not _CLOSED.search(core[-2:]), bool(mark), "«" in answer or "—" in answer, "<" in answer or "[" in answer
        else:
            ends[i, 0] = 1.0
        answer_ids.append(ids)
    codes, letters, latin, spoken = lexicon.tables()
    flat = lambda lists: np.fromiter((i for x in lists for i in x), dtype=np.int64)
    sizes = lambda lists: np.array([len(x) for x in lists], dtype=np.int64)
    t_all, n_all, a, m = flat(text_ids), sizes(text_ids), flat(answer_ids), sizes(answer_ids)
    n = n_all[of_text]
    # distinct words of both sides and those they share
    a_codes, t_codes = codes[a], codes[t_all]
    a_row, t_row = np.repeat(np.arange(len(m)), m), np.repeat(np.arange(len(n_all)), n_all)
    a_keys, t_keys = np.unique(a_row << 31 | a_codes), np.unique(t_row << 31 | t_codes)
    want = of_text[a_keys >> 31] << 31 | (a_keys & 0x7FFFFFFF)
    at = np.minimum(np.searchsorted(t_keys, want), max(len(t_keys) - 1, 0))
    met = t_keys[at] == want if len(t_keys) else np.zeros(len(want), dtype=bool)
    both = np.bincount((a_keys >> 31)[met], minlength=len(m))
    kinds, t_kinds = np.bincount(a_keys >> 31, minlength=len(m)), np.bincount(t_keys >> 31, minlength=len(n_all))[of_text]
    whole, of_latin = _sums(letters[a], m), _sums(latin[a], m)
    text_latin = (_sums(latin[t_all], n_all) * 2 > _sums(letters[t_all], n_all))[of_text]
    own = _sums(spoken[t_all], n_all).argmax(1)[of_text]
    score = _sums(spoken[a], m)
    apart = np.where(m > 0, score.max(1) - score[np.arange(len(m)), own], 0.0)
    # letters of sentences that another language fits far better
    u_row, u_sizes = np.array(unit_row, dtype=np.int64), sizes(units)
    u_score, u_letters = _sums(spoken[a], u_sizes), _sums(letters[a] * (spoken[a] != 0).any(1), u_sizes)
    odd = u_score.max(1, initial=-np.inf) - u_score[np.arange(len(u_row)), own[u_row]] > ODDS + ODDS_A_LETTER * u_letters
    share = np.bincount(u_row, weights=u_letters * odd, minlength=len(m)) / np.maximum(np.bincount(u_row, weights=u_letters, minlength=len(m)), 1)
    nothing = np.array([k <= 3 and is_empty(answer) for k, answer in zip(m.tolist(), answers)], dtype=bool)
    foreign = (n > 0) & (share > 0.5) & ~nothing
    most = (n * CHANGED).astype(np.int64)
    copy = (n > 0) & (np.abs(n - m) <= most) & (t_kinds - both <= most)
    a_at, t_at = np.cumsum(m) - m, np.cumsum(n_all) - n_all
    for i in np.flatnonzero(copy).tolist():
        t = of_text[i]
        copy[i] = distance_within(t_codes[t_at[t] : t_at[t] + n[i]].tolist(), a_codes[a_at[i] : a_at[i] + m[i]].tolist(), int(most[i]))
    of_latin_share = of_latin / np.maximum(whole, 1)
    pair = np.column_stack([
        np.ones(len(m)), m == 0, (m > 0) & (m <= 4), both / np.maximum(kinds, 1), both / np.maximum(t_kinds, 1), m < 0.8 * n, m > 1.25 * n, of_latin_share,
        np.where(m > 0, 1 - of_latin_share, 0.0), (n > 0) & ((of_latin * 2 > whole) != text_latin), ends, apart > ODDS + ODDS_A_LETTER * whole, nothing, copy, foreign, share,
    ]).astype(float)
    # words and word pairs; a pair counts with its first word's row
    joined = np.flatnonzero(np.diff(a_row) == 0)
    places = np.concatenate([a_codes, a_codes[joined] * 1_000_003 + a_codes[joined + 1] * 7919]) % WORDS
    order = np.argsort(np.concatenate([a_row, a_row[joined]]), kind="stable")
    return Features(pair, places[order], m + np.maximum(m - 1, 0), nothing, copy, foreign)


@dataclass
class Model:
    """Weights (words + pair features + the cut flag, defects), thresholds and the language model's table."""

    words: np.ndarray
    pair: np.ndarray
    flag: np.ndarray
    thresholds: np.ndarray
    languages: np.ndarray

    def logits(self, f: Features) -> np.ndarray:
        """Scores of a batch by defect, without the cut flag."""
        found = _sums(self.words[f.places], f.sizes) / np.sqrt(np.maximum(f.sizes, 1))[:, None]
        return found + f.pair @ self.pair


def refusal(rng: np.random.Generator) -> str:
    """A made-up refusal."""
    lang = rng.choice(list(REFUSALS), p=[0.6, 0.06, 0.22, 0.06, 0.06])
    opening, core, verb, thing, end = (str(rng.choice(part)) for part in REFUSALS[lang])
    out = opening + core.format(v=verb, o=thing) + end
    out = out[0].upper() + out[1:]
    return out.lower() if rng.random() < 0.15 else out


def cut_text(text: str, rng: np.random.Generator) -> str:
    """A text broken off at random, with or without a mark."""
    at = int(rng.integers(min(20, len(text) - 1), len(text)))
    return text[:at] + str(rng.choice(["", "", "", "…", "...", " [...]", "<…>", "� ", ","])).rstrip()


def copied(text: str, rng: np.random.Generator) -> str:
    """A text with small changes."""
    words = text.split()
    for _ in range(int(rng.integers(0, max(1, int(len(words) * CHANGED)) + 1))):
        at = int(rng.integers(len(words)))
        if rng.random() < 0.5:
            words[at] = str(rng.choice(words))
        elif len(words) > 2:
            words.pop(at)
    out = " ".join(words)
    style = rng.random()
    return out.lower() if style < 0.2 else out.upper() if style < 0.3 else re.sub(r"[^\w\s]", "", out) if style < 0.45 else out


def train(pairs: list[tuple[str | None, str | None, bool]], seed: int = 5) -> Model:
    """Fit the classifier on pairs (text, answer, cut flag) and answers broken on purpose."""
    rng = np.random.default_rng(seed)
    languages = fit_languages([a for _, a, _ in pairs if a] + list({t for t, _, _ in pairs if t}))
    lexicon = Lexicon(languages)
    pairs = [p for p in pairs if p[0] and p[0].strip()]
    seeds = {w.translate(_TABLE) for lang in REFUSALS.values() for part in lang for p in part for w in words_of_text(p) if len(w) > 3}

    def refuses(answer: str | None) -> bool:
        """Whether an answer holds many words of refusals outside of quotations."""
        words = own = words_of_text(answer or "")
        if answer and any(mark in answer for mark in '"«—“'):
            own = words_of_text(_QUOTED.sub(" ", answer))
        hits = sum(w.translate(_TABLE) in seeds for w in own)
        return bool(own) and len(own) >= 0.6 * len(words) and hits >= max(2, 0.25 * len(own))

    real = _featured([p[:2] for p in pairs], lexicon)
    doubtful = np.array([not nothing and refuses(p[1]) for nothing, p in zip(real.nothing, pairs)], dtype=bool)
    labels = np.zeros((len(pairs), len(DEFECTS)))
    empty, refused, truncated, copy, other = range(len(DEFECTS))
    labels[:, empty], labels[:, copy], labels[:, other] = real.nothing, real.copy & ~real.nothing, real.foreign & ~real.copy
    flags = np.array([float(p[2]) for p in pairs])
    labels[:, truncated] = (flags > 0) & ~real.nothing
    foreign = [p[1] for p, yes in zip(pairs, real.foreign & ~doubtful) if yes][:2000]
    made: list[tuple[str, str, float, int]] = []
    for (text, answer, flag), suspect in zip(pairs, doubtful):
        kind = rng.integers(6)
        if kind == 0 and len(answer or "") > 40 and not suspect:
            made.append((text, cut_text(answer, rng), float(rng.random() < 0.97), truncated))
        elif kind == 1:
            made.append((text, copied(text, rng), float(flag), copy))
        elif kind == 2 and foreign:
            swapped = str(rng.choice(foreign))
            made.append((text, swapped, 0.0, other) if rng.random() < 0.7 else (swapped, text, 0.0, other))
        elif kind in (3, 4):
            r = refusal(rng)
            made.append((text, cut_text(r, rng) if rng.random() < 0.15 and len(r) > 40 else r, 0.0, refused))
        elif kind == 5:
            made.append((text, str(rng.choice(["", " ", "—", "...", "N/A", "null", "<s></s>", "[]", "нет ответа", "«»"])), 0.0, empty))
    broken = _featured([p[:2] for p in made], lexicon)
    made_labels = np.zeros((len(made), len(DEFECTS)))
    made_labels[np.arange(len(made)), np.array([p[3] for p in made], dtype=np.int64)] = 1.0
    grams, made_grams = real.grams(), broken.grams()

    def fit(rows: np.ndarray, y: np.ndarray) -> Model:
        return _fit(
            made_grams[: len(made)] + [grams[i] for i in rows], np.concatenate([broken.pair, real.pair[rows]]),
            np.concatenate([[p[2] for p in made], flags[rows]]), np.concatenate([made_labels, y]), rng,
        )

    # real answers enter by rounds: what looks like a refusal is left out at first, then takes the label that the
    # model of the round before gives it when that is sure, so that the wording of the corpus is learnt
    rows = np.flatnonzero(~doubtful)
    model = fit(rows, labels[rows])
    for _ in range(2):
        score = model.logits(real)[:, refused]
        sure, plain = np.flatnonzero((score > 0) & ~real.nothing), np.flatnonzero((score < -3) | real.nothing)
        told = np.zeros((len(sure), len(DEFECTS)))
        told[:, refused] = 1.0
        model = fit(np.concatenate([sure, sure, sure, plain]), np.concatenate([told, told, told, labels[plain]]))
    model.languages = languages.table
    return model


def _featured(pairs: list[tuple[str | None, str | None]], lexicon: Lexicon) -> Features:
    parts = [features([p[0] for p in pairs[i : i + ROWS]], [p[1] for p in pairs[i : i + ROWS]], lexicon) for i in range(0, max(len(pairs), 1), ROWS)]
    return Features(*[np.concatenate([getattr(p, name) for p in parts]) for name in Features.__dataclass_fields__])


def _fit(
    grams: list[np.ndarray], pair_x: np.ndarray, flag_x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 8, rate: float = 1.0,
    ridge: float = 1e-5, size: int = 32,
) -> Model:
    """Logistic regression of all labels at once by stochastic gradients; thresholds on the last fifth."""
    n, k = len(grams), len(DEFECTS)
    mixed = rng.permutation(n)
    hold = max(1, n // 5)
    fitted, held = mixed[: n - hold], mixed[n - hold :]
    words, pair, flag = np.zeros((k, WORDS), np.float32), np.zeros((len(PAIR), k)), np.zeros(k)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        order = fitted[rng.permutation(len(fitted))] if len(fitted) else fitted
        for at in range(0, len(order), size):
            part = order[at : at + size]
            some = [grams[i] for i in part]
            counts = np.array([len(g) for g in some])
            ids = np.concatenate(some)
            row = np.repeat(np.arange(len(part)), counts)
            scale = 1 / np.sqrt(np.maximum(counts, 1))
            x, f = pair_x[part], flag_x[part]
            z = x @ pair + np.outer(f, flag)
            for j in range(k):
                z[:, j] += np.bincount(row, words[j][ids], len(part)) * scale
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]
            for j in range(k):
                np.subtract.at(words[j], ids, (step * g[:, j] * scale)[row].astype(np.float32))
            pair -= 0.1 * step * (x.T @ g / 4 + ridge * pair)
            flag -= 0.1 * step * (f @ g) / 4
    model = Model(np.ascontiguousarray(words.T), pair, flag, np.zeros(k), np.zeros(0))
    sizes = np.array([len(g) for g in grams], dtype=np.int64)
    whole = Features(pair_x, np.concatenate(grams) if n else np.zeros(0, np.int64), sizes, *[np.zeros(n, bool)] * 3)
    scores = model.logits(whole) + np.outer(flag_x, flag)
    for j in range(k):
        true = np.sort(scores[held, j][y[held, j] > 0]) if n else np.zeros(0)
        model.thresholds[j] = min(true[int((1 - KEPT) * len(true))], 0.0) if len(true) else 0.0
    # no exact check stands behind a refusal, so its threshold also keeps all but one in 2,000 other answers out
    j = DEFECTS.index("refusal")
    others = np.sort(scores[:, j][y[:, j] == 0])
    model.thresholds[j] = max(model.thresholds[j], others[int(0.9995 * (len(others) - 1))] if len(others) else 0.0)
    return model


def find_defects(df: DataFrame, id_col: str, text: str, answer: str, fields: dict[str, str], sample: int = SAMPLE) -> DataFrame:
    """(id_col, defect): one row per row of ``df`` whose answer is defective, with the first defect of DEFECTS.

    ``fields`` are the text fields and sources for the detection of cut values, ``answer`` among them. A null answer
    is empty. Copies and other languages need a text that is not null or blank. Repeated rows count each. Texts are
    read whole. An empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{answer}`").alias("answer"))
    cut_rows = find_truncated(df, id_col, fields).filter(F.col("field") == answer).select(F.col(id_col).alias("id"), F.lit(True).alias("cut")).distinct()
    cut_rows = cut(cut_rows)
    thin = max(1, rows.count() // (2 * sample))
    mark = F.xxhash64(F.lit(23), "id", "answer")
    some = rows.filter(F.pmod(mark, F.lit(thin)) == 0).orderBy(mark, "id", "answer", "text").limit(sample)
    taken = some.join(cut_rows, "id", "left").select("text", "answer", F.coalesce("cut", F.lit(False)).alias("cut"), "id").collect()
    taken.sort(key=lambda r: (str(r["id"]), r["answer"] or "", r["text"] or ""))
    model = spark.sparkContext.broadcast(train([(r["text"], r["answer"], r["cut"]) for r in taken]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        lexicon = Lexicon(Languages(m.languages))
        empty, refused, _, copy, other = range(len(DEFECTS))
        reach = m.thresholds - np.maximum(m.flag, 0)  # what may pass once the flag is known
        for whole in batches:
            sizes = [pc.fill_null(pc.binary_length(whole.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2)]
            ends = np.cumsum(sizes[0] + sizes[1])
            at = 0
            while at < whole.num_rows:
                to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, "right"))
                batch = whole.slice(at, max(1, min(to - at, ROWS)))
                at += batch.num_rows
                f = features(batch.column(1).to_pylist(), batch.column(2).to_pylist(), lexicon)
                z = m.logits(f)
                near = z >= reach
                near[:, empty] &= f.nothing
                near[:, refused] &= ~f.nothing
                near[:, copy] &= f.copy
                near[:, other] &= f.foreign
                lexicon.forget()
                keep = near.any(1)
                columns = [pa.array(z[keep, j], mask=~near[keep, j]) for j in range(len(DEFECTS))]
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), *columns], names=["id", *DEFECTS])

    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(score, f"id {kind}, " + ", ".join(f"{d} double" for d in DEFECTS))
    m: Model = model.value
    flagged = scored.join(cut_rows, "id", "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
    defect = F.lit(None).cast("string")
    for i, d in reversed(list(enumerate(DEFECTS))):
        ok = F.col(d) + F.when(F.col("cut"), float(m.flag[i])).otherwise(0.0) >= float(m.thresholds[i])
        if d == "truncated":
            ok = ok & F.col("cut")
        defect = F.when(ok, d).otherwise(defect)
    return flagged.select(F.col("id").alias(id_col), defect.alias("defect")).filter("defect is not null")
