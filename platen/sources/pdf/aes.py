"""AES in cipher block chaining: encryption by tables of words, decryption of all blocks at once."""

from __future__ import annotations

import struct

import numpy as np


def _double(x: int) -> int:
    return (x << 1) ^ (0x11B if x & 0x80 else 0)


def _times(a: int, b: int) -> int:
    """Product in the field of 256 elements."""
    out = 0
    while b:
        out, a, b = out ^ (a if b & 1 else 0), _double(a), b >> 1
    return out


def _substitution() -> list[int]:
    """The S-box: the inverse in the field, then the affine map."""
    power, log, x = [0] * 255, [0] * 256, 1
    for k in range(255):
        power[k], log[x], x = x, k, x ^ _double(x)
    out = []
    for v in range(256):
        inverse = power[-log[v] % 255] if v else 0
        spread = inverse * 0x101  # rotations become shifts
        out.append((inverse ^ spread >> 7 ^ spread >> 6 ^ spread >> 5 ^ spread >> 4 ^ 0x63) & 255)
    return out


SBOX = _substitution()
_INVERSE = np.argsort(SBOX).astype(np.uint8)
#: What a byte in each row of a column adds to the column, substitution included.
_COLUMN = [[_times(s, 2) << 24 | s << 16 | s << 8 | _times(s, 3) for s in SBOX]]
for _ in range(3):
    _COLUMN.append([v >> 8 | (v & 255) << 24 for v in _COLUMN[-1]])
_BY = {k: np.array([_times(v, k) for v in range(256)], np.uint8) for k in (9, 11, 13, 14)}
#: Where each byte of the state comes from when the rows are shifted back.
_BACK = np.array([(4 * ((i // 4 - i % 4) % 4)) + i % 4 for i in range(16)])


class Aes:
    def __init__(self, key: bytes):
        n = len(key) // 4
        words, step = list(struct.unpack(f">{n}I", key)), 1

        def substitute(w: int) -> int:
            return int.from_bytes(bytes(SBOX[c] for c in w.to_bytes(4, "big")), "big")

        for i in range(n, 4 * (n + 7)):
            w = words[-1]
            if i % n == 0:
                w = substitute((w << 8 | w >> 24) & 0xFFFFFFFF) ^ step << 24
                step = _double(step)
            elif n > 6 and i % n == 4:
                w = substitute(w)
            words.append(words[i - n] ^ w)
        self.rounds = [words[i : i + 4] for i in range(0, len(words), 4)]

    def _block(self, state: list[int]) -> list[int]:
        a, b, c, d = _COLUMN
        state = [s ^ k for s, k in zip(state, self.rounds[0])]
        for keys in self.rounds[1:-1]:
            state = [a[state[i] >> 24] ^ b[state[i - 3] >> 16 & 255] ^ c[state[i - 2] >> 8 & 255] ^ d[state[i - 1] & 255] ^ keys[i] for i in range(4)]
        return [(SBOX[state[i] >> 24] << 24 | SBOX[state[i - 3] >> 16 & 255] << 16 | SBOX[state[i - 2] >> 8 & 255] << 8 | SBOX[state[i - 1] & 255]) ^ k for i, k in enumerate(self.rounds[-1])]

    def encrypt(self, data: bytes, iv: bytes) -> bytes:
        """``data`` of whole blocks."""
        last, out = list(struct.unpack(">4I", iv)), []
        for block in struct.iter_unpack(">4I", data):
            last = self._block([x ^ y for x, y in zip(block, last)])
            out.append(struct.pack(">4I", *last))
        return b"".join(out)

    def decrypt(self, data: bytes, iv: bytes) -> bytes:
        """The whole blocks of ``data``."""
        blocks = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)
        keys = np.array(self.rounds, ">u4").view(np.uint8).reshape(-1, 16)
        x = blocks ^ keys[-1]
        for r in range(len(keys) - 2, -1, -1):
            x = _INVERSE[x[:, _BACK]] ^ keys[r]
            if r:
                c = x.reshape(-1, 4, 4)
                x = (_BY[14][c] ^ _BY[11][np.roll(c, -1, 2)] ^ _BY[13][np.roll(c, -2, 2)] ^ _BY[9][np.roll(c, -3, 2)]).reshape(-1, 16)
        before = np.concatenate([np.frombuffer(iv, np.uint8)[None, :], blocks])[: len(blocks)]
        return (x ^ before).tobytes()
