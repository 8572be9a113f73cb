"""Arrow batches, a block of rows at a time.

Texts take up to four bytes a character in Python, and results stand beside them; a block bounds both whatever a batch holds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are Python objects at a time, but for a single larger text.
BLOCK = 2 << 20


def in_blocks(run: Callable[..., pa.Array], texts: pa.Array, *others: pa.Array) -> pa.Array:
    """``run(texts, *others)``, computed over blocks of consecutive rows."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.cumsum(sizes) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
    return pa.concat_arrays([run(*[c.slice(a, b - a) for c in (texts, *others)]) for a, b in zip(cuts, cuts[1:])])
