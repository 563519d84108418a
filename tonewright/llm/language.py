"""Languages of sentences: a character model that starts from a few function words and learns from the corpus.

Words in a script of none of the listed languages count for one more language, which stands for all of those.
"""

from __future__ import annotations

import numpy as np

from tonewright.llm.folding import fold
from tonewright.llm.truncation import _UNIT, _WORD

#: Frequent function words of each language.
FUNCTION_WORDS = {
    "ru": "и в не на что как это его из для был была было чтобы когда потом все этому по от к у за о он она они но же бы если где уже ещё или после через только этот так вот",
    "uk": "і й та що не на як це його із для був була було щоб коли потім все він вона вони але же якщо де вже ще або після через лише цей так ось біля навіщо ніхто знову з у до",
    "bg": "и в не на че как това го от за беше да когато после всичко той тя те но ако къде вече още или след през само този така ето край защо никой отново се е с по",
    "sr": "и у не на да како то га из за је био била кад после све он она они али ако где већ још или кроз само тај тако ево поред зашто нико није опет се код од са",
    "en": "the and of to in that it was for on with as he she they but if where already or after through only this so here by who not had his her again about from",
    "de": "der die das und in nicht dass es war für auf mit als er sie aber wenn wo schon noch oder nach durch nur dieser so hier von wer hatte sein wieder über aus zu den dem",
    "es": "el la los las y de que en un una no se por con para como pero si donde ya todavía o después solo este así aquí quien había su otra vez sobre del al más muy",
    "it": "il lo la gli le e di che in un una non si per con come ma se dove già ancora o dopo solo questo così qui chi aveva suo di nuovo sulla del della nella più molto",
    "pt": "o a os as e de que em um uma não se por com para como mas onde já ainda ou depois só este assim aqui quem tinha seu outra vez sobre do da no na mais muito",
    "pl": "i w nie na że co jak to jego z dla był była było żeby kiedy potem wszystko ten po od do za o on ona oni ale czy jeśli gdzie już jeszcze albo przez tylko tak oto się",
    "nl": "de het een en van dat in niet is was voor op met als hij zij maar of waar al nog na door alleen deze zo hier wie had zijn weer over uit te den",
    "tr": "ve bir bu için da de ne gibi ama eğer nerede zaten hâlâ veya sonra kadar sadece böyle burada kim onun yine hakkında ile çok daha değil her şey o ben",
    "fr": "le la les et de du des dans que il elle était pour sur avec comme mais si où déjà encore ou après par seulement ce cette ainsi ici qui ne pas son sa jusqu au un une",
}
LANGUAGES = list(FUNCTION_WORDS)
DIM = 1 << 14
#: Share of the even distribution in each language's trigrams, and the odds (in logarithms) a sentence needs to
#: count as foreign: so many, and so many more a letter, as the trigrams of a sentence overlap and repeat each other's evidence.
EVEN, ODDS, ODDS_A_LETTER = 0.1, 4.0, 0.5
#: Log-likelihood of a trigram in a script that a language does not use.
NEVER = -14.0
_SEEDS: dict[str, list[int]] = {}
for _n, _text in enumerate(FUNCTION_WORDS.values()):
    for _w in _text.split():
        _SEEDS.setdefault(fold(_w), []).append(_n)


def units_of(text: str) -> list[list[str]]:
    """The folded words of each sentence."""
    out = [_WORD.findall(fold(u)) for u in _UNIT.split(text) if u]
    return [u for u in out if u]


def _grams(word: str) -> list[int]:
    import zlib

    w = f" {word} "
    return [zlib.crc32(w[i : i + 3].encode()) % DIM for i in range(len(w) - 2)]


def votes(words: list[str]) -> np.ndarray:
    """Words that only one language has among its function words, by language."""
    out = np.zeros(len(LANGUAGES))
    for w in words:
        if len(_SEEDS.get(w, ())) == 1:
            out[_SEEDS[w][0]] += 1
    return out


def _elsewhere(word: str) -> bool:
    """Whether a word is written in a script of none of the listed languages."""
    return word[0].isalpha() and not ("a" <= word[0] < "\u0250" or "\u0400" <= word[0] < "\u0530")


class Languages:
    """Log-likelihoods of the character trigrams of words by language, the last place being that of other scripts."""

    def __init__(self, table: np.ndarray):
        self.table, self.width = table, len(LANGUAGES) + 1

    def row(self, word: str) -> np.ndarray:
        """The log-likelihoods of a word; zeros for a number."""
        if word[0].isdigit():
            return np.zeros(self.width)
        grams = _grams(word)
        if _elsewhere(word):
            return np.append(np.full(len(LANGUAGES), NEVER * len(grams)), 0.0)
        return np.append(self.table[grams].sum(0), NEVER * len(grams))


def fit_languages(texts: list[str]) -> Languages:
    """Learn the trigrams of sentences whose function words name one language; function words alone give the start.

    Sentences without such words count with their text when its function words name one language clearly.
    """
    counts = np.zeros((len(LANGUAGES), DIM))
    for lang, text in enumerate(FUNCTION_WORDS.values()):
        for w in text.split():
            np.add.at(counts[lang], _grams(fold(w)), 3.0)

    def named(words: list[str], times: float) -> int:
        v = votes(words)
        first, second = np.argsort(-v)[:2]
        return int(first) if v[first] >= 2 and v[first] >= times * v[second] else -1

    for text in texts:
        units = units_of(text)
        whole = named([w for unit in units for w in unit], 5)
        for unit in units:
            lang = named(unit, 3)
            lang = whole if lang < 0 else lang
            if lang >= 0:
                np.add.at(counts[lang], [g for w in unit for g in _grams(w)], 1.0)
    shares = (1 - EVEN) * counts / counts.sum(1, keepdims=True) + EVEN / DIM
    return Languages(np.log(shares).T.copy())
