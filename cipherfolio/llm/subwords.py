"""Character n-grams of words as hashed buckets, made for many words at once, and dictionaries of small batches of texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np

#: Fixed parameters of the feature space: n-gram lengths, and buckets as a power of two.
LEAST_GRAM, MOST_GRAM = 3, 5
BUCKETS = 1 << 18
LONGEST_WORD = 40
#: Words whose n-grams are held at a time while they are weighed.
WORDS_AT_ONCE = 1 << 13
#: Odd multipliers that spread the code points of an n-gram over 64 bits.
STEP, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def grams_by_size(words: list[str], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(number of the word, bucket)`` of the words themselves, in brackets, and then of their n-grams, one length after the other."""
    marked = [f"<{word}>" for word in words]
    mask = np.uint64(buckets - 1)
    yield np.arange(len(words)), (np.array([crc32(w.encode("utf-8", "surrogatepass")) for w in marked], np.uint64) & mask).astype(np.int64)
    letters = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    word_of = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(letters))  # letters from here to the word's end
    rolled = letters
    for size in range(2, MOST_GRAM + 1):
        rolled = rolled[: len(letters) - size + 1] * STEP + letters[size - 1 :] if len(letters) >= size else rolled[:0]
        if size >= LEAST_GRAM:
            whole = left[: len(rolled)] >= size
            mixed = rolled[whole] * SPREAD
            yield word_of[: len(rolled)][whole], ((mixed ^ (mixed >> np.uint64(29))) & mask).astype(np.int64)


def grams_of(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """``(number of the word, bucket)`` of each word itself and of all its n-grams of 3 to 5 characters."""
    numbers, found = zip(*grams_by_size(words, buckets), strict=True)
    return np.concatenate(numbers), np.concatenate(found)


def grams(word: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of one word."""
    return grams_of([word], buckets)[1].tolist()


def cut_long(words: list[str]) -> list[str]:
    """A run longer than 40 letters is cut, so a text without spaces is many words and none of it is lost."""
    return [part for word in words for part in ((word,) if len(word) <= LONGEST_WORD else (word[i : i + LONGEST_WORD] for i in range(0, len(word), LONGEST_WORD)))]


def words_of(text: str | None) -> list[str]:
    """Lower-cased words at white space."""
    return cut_long(text.lower().split()) if text else []


def words_as_written(text: str | None) -> list[str]:
    return cut_long(text.split()) if text else []


def bare(word: str) -> str:
    """A word without punctuation at its ends."""
    return word.strip(".,;:!?\"'()[]{}<>|%$&*#") or word


class Numbers(dict):
    """Word -> its number in order of appearance."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class WordCounts:
    """Texts as counts over one dictionary of their distinct words: what is said of a word is worked out once for all texts."""

    def __init__(self, words: list[str], ends: np.ndarray, at: np.ndarray, counts: np.ndarray) -> None:
        self.words, self.ends, self.at, self.counts = words, ends, at, counts
        self.text_of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))

    @classmethod
    def of(cls, texts: Iterable[list[str]]) -> WordCounts:
        numbers, at, counts, ends, total = Numbers(), [], [], [], 0
        for words in texts:
            found = Counter(words)
            at.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
            counts.append(np.fromiter(found.values(), np.int64, len(found)))
            total += len(found)
            ends.append(total)
        nothing = [np.zeros(0, np.int64)]
        return cls(list(numbers), np.array(ends, np.int64), np.concatenate(at or nothing), np.concatenate(counts or nothing))

    def sums(self, of_words: np.ndarray) -> np.ndarray:
        """Per text the sum of a number per word (words, or words x columns), repeats included."""
        columns = (of_words if of_words.ndim > 1 else of_words[:, None]).T
        found = [np.bincount(self.text_of, column[self.at] * self.counts, len(self.ends)) for column in columns]
        return np.stack(found, axis=1).reshape(len(self.ends), *of_words.shape[1:])

    def mean_weights(self, models: np.ndarray, spelled: list[str] | None = None) -> np.ndarray:
        """Per text and model (models x buckets) the mean weight of all n-grams of all words; 0 where there is none.

        Some thousand words are looked at a time, so memory does not follow the n-grams of a large dictionary.
        """
        spelled = self.words if spelled is None else spelled
        per_word = np.zeros((len(models) + 1, len(spelled)))
        for start in range(0, len(spelled), WORDS_AT_ONCE):
            own = per_word[:, start : start + WORDS_AT_ONCE]
            for word_of, bucket in grams_by_size(spelled[start : start + WORDS_AT_ONCE], models.shape[1]):
                for number, model in enumerate(models):
                    own[number] += np.bincount(word_of, model[bucket], own.shape[1])
                own[-1] += np.bincount(word_of, minlength=own.shape[1])
        sums = self.sums(per_word.T)
        return sums[:, :-1] / np.maximum(sums[:, -1:], 1)
