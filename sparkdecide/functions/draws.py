"""Random draws of many rows at once, in numpy, from counted uniforms that every SQL engine makes alike."""

from __future__ import annotations

import numpy as np

#: Constants of the mixing steps, both under 2**31 so that no product leaves 63 bits, and of the counters.
MIX_A, MIX_B, STEP = 0x21F0AAAD, 0x7FEB352D, 0x9E3779B1
WORD = 0xFFFFFFFF
#: Proposals of a Gamma draw; each is taken with a probability above 0.95.
PROPOSALS = 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A 32-bit mix (xor-shifts and multiplications) of numbers from 0 to 2**32 - 1, in 64 bits."""
    x = ((x ^ (x >> 16)) * MIX_A) & WORD
    x = ((x ^ (x >> 15)) * MIX_B) & WORD
    return x ^ (x >> 15)


def key_hash(key: np.ndarray, stream: np.ndarray, seed: int) -> np.ndarray:
    """32 bits from an integer key, a stream (an integer) and the seed."""
    h = mixed((stream & WORD) ^ (seed * STEP & WORD))
    h = mixed(h ^ (key & WORD))
    return mixed(h ^ ((key >> 32) & WORD))


def counter_uniform(hashed: np.ndarray, counter: int) -> np.ndarray:
    """Number ``counter`` of the uniforms in (0, 1) that belong to a key's hash."""
    return (mixed(hashed ^ (counter * STEP & WORD)) + 0.5) / 4294967296.0


def gamma_draw(hashed: np.ndarray, shape: np.ndarray, first: int = 0) -> np.ndarray:
    """Draws of Gamma(shape, 1), shape 1 or more, from the uniforms from number ``first`` on.

    Cubes of normal numbers, accepted or proposed again for those that aren't. After PROPOSALS refusals (a probability under
    1e-20) a draw is the mode of the proposals, so that the number of uniforms has a bound.
    """
    out = shape - 1.0 / 3.0
    open_ = np.arange(len(out))
    for k in range(PROPOSALS):
        d, h = out[open_], hashed[open_]
        u, w, accept = (counter_uniform(h, first + 3 * k + i) for i in range(3))
        z = np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * np.pi * w)
        root = 1.0 + z / np.sqrt(9.0 * d)
        v = root * root * root
        taken = (v > 0) & (np.log(accept) < 0.5 * z * z + d * (1.0 - v + np.log(np.where(v > 0, v, 1.0))))
        out[open_[taken]] = (d * v)[taken]
        open_ = open_[~taken]
        if not len(open_):
            break
    return out


def beta_draw(key: np.ndarray, alpha: np.ndarray, beta: np.ndarray, seed: int = 1, stream: np.ndarray | int = 0) -> np.ndarray:
    """Draws of Beta(alpha, beta), both 1 or more, that depend on an integer key, the stream and the seed alone."""
    h = key_hash(key, np.broadcast_to(np.asarray(stream, np.int64), key.shape), seed)
    x = gamma_draw(h, alpha)
    return x / (x + gamma_draw(h, beta, 3 * PROPOSALS))
