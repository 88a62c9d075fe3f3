"""Many words in one pass over a text, whatever their number."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, functions as F

#: So many texts and their positions are Python objects at once.
ROWS = 128


def finder(words: Sequence[str]) -> Callable[[str], list[int]]:
    """A function from a text to the ascending positions of the words it holds.

    Equal words count each; the empty word is in every text.
    """
    import ahocorasick

    machine, places, always = ahocorasick.Automaton(), {}, []
    for place, word in enumerate(words):
        if word:
            places.setdefault(word, []).append(place)
        else:
            always.append(place)
    for word, at in places.items():
        machine.add_word(word, at)
    if not places:
        return lambda text: always
    machine.make_automaton()

    def found(text: str) -> list[int]:
        # the lists are those of the words, so a word met often is one entry
        met = {id(at): at for _, at in machine.iter(text)}
        return sorted([*always, *(place for at in met.values() for place in at)])

    return found


def places_in(batches: Iterator[pa.Array], words: Sequence[str]) -> Iterator[pa.Array]:
    """Per batch of texts the positions of the words each holds. ``ROWS`` texts and their positions are Python objects at once."""
    found = finder(words)
    for batch in batches:
        parts = []
        for at in range(0, len(batch), ROWS):
            rows = [found(v.as_py()) if v.is_valid else [] for v in batch.slice(at, ROWS)]
            parts.append(pa.array(rows, pa.list_(pa.int32())))
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def word_places(text: Column, words: Sequence[str]) -> Column:
    """Positions in ``words`` of those that are substrings of ``text``, ascending; of a null text none.

    A task builds the automaton once and reads each text once, in Arrow batches. The words are
    configuration: they travel with the function.
    """
    words = tuple(words)

    @F.arrow_udf("array<int>")
    def places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from places_in(batches, words)

    return places(text)
