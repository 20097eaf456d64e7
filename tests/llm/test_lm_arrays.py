"""Array forms of the language model against plain loops."""

from __future__ import annotations

import numpy as np

from tallyloom.llm import lm_score

BITS = (8, 9, 9, 9)


def test_both_counts_of_a_slot_are_one_addition():
    own = lm_score.SlotCounts(BITS)
    assert own.counts[0].dtype == np.uint32
    own.counts[0][6] = 2**32 - 2
    found = lm_score.Decisions([np.array([3, 3, 3, 5])] * 4, np.array([1, 0, 1, 1], np.uint8), np.array([0, 4]))
    own.add(found)
    assert own.counts[0][[6, 7, 10, 11]].tolist() == [2**32 - 1, 2, 0, 1]
    assert [int(c.sum()) for c in own.counts[1:]] == [4, 4, 4]


def test_slots_are_those_of_a_loop_over_bytes():
    code = lm_score.huffman(np.arange(256))
    units = [unit for text in ("", "one two  one", "été 7", "x" * 40) for unit in lm_score.units_of(lm_score.words_of(text))]
    found = lm_score.decisions(units, code, BITS)
    data = b"".join(lead + own for lead, own in units)
    bases = lm_score.contexts(np.frombuffer(data, np.uint8), BITS)
    want, bits, begins, at = [[] for _ in BITS], [], [0], 0
    for lead, own in units:
        at += len(lead)
        for byte in own:
            for i in range(code.offsets[byte], code.offsets[byte] + code.lengths[byte]):
                bits.append(int(code.bits[i]))
                for out, base in zip(want, bases, strict=True):
                    out.append(int(base[at] + code.nodes[i]))
            at += 1
        begins.append(len(bits))
    assert [s.tolist() for s in found.slots] == want and found.bits.tolist() == bits and found.begins.tolist() == begins
