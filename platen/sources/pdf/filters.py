"""Stream filters and predictors; unknown filters pass bytes through, and broken data gives what can be read. A stream
that unpacks to more than MOST bytes is an error, never a prefix."""

from __future__ import annotations

import re
import zlib

import numpy as np

from .errors import MOST_BYTES, within

def flate(data: bytes) -> bytes:
    for wbits in (15, -15):
        unpack, out, at = zlib.decompressobj(wbits), bytearray(), 0
        try:
            while at < len(data) and not unpack.eof:
                out += unpack.decompress(data[at : at + 65536], MOST_BYTES + 1 - len(out))
                at += 65536
                while unpack.unconsumed_tail and len(out) <= MOST_BYTES:
                    out += unpack.decompress(unpack.unconsumed_tail, MOST_BYTES + 1 - len(out))
                within(len(out), MOST_BYTES, "bytes of a stream")
            return bytes(out + unpack.flush())
        except zlib.error:
            if out:
                return bytes(out)
    return b""


def ascii85(data: bytes) -> bytes:
    data = re.sub(rb"[\x00\t\n\x0c\r ]", b"", data.split(b"~", 1)[0])
    out, group = bytearray(), []
    for c in data:
        if c == 0x7A and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                n = 0
                for g in group:
                    n = n * 85 + g
                out += (n & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
        else:
            raise ValueError("invalid ASCII85 digit")
    if len(group) > 1:
        n = 0
        for g in group + [84] * (5 - len(group)):
            n = n * 85 + g
        out += (n & 0xFFFFFFFF).to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def ascii_hex(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">", 1)[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        within(len(out), MOST_BYTES, "bytes of a stream")
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def lzw(data: bytes, early: int = 1) -> bytes:
    table: list[bytes] = []
    out, bits, have, width, last = bytearray(), 0, 0, 9, b""

    def reset():
        table[:] = [bytes([i]) for i in range(256)] + [b"", b""]

    reset()
    for byte in data:
        bits, have = (bits << 8) | byte, have + 8
        while have >= width:
            code = (bits >> (have - width)) & ((1 << width) - 1)
            have -= width
            bits &= (1 << have) - 1
            within(len(out), MOST_BYTES, "bytes of a stream")
            if code == 257:
                return bytes(out)
            if code == 256:
                reset()
                width, last = 9, b""
                continue
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                return bytes(out)
            out += entry
            if last:
                table.append(last + entry[:1])
            last = entry
            width = 9 + (len(table) + early >= 512) + (len(table) + early >= 1024) + (len(table) + early >= 2048)
    return bytes(out)


def predict(data: bytes, parms: dict) -> bytes:
    kind = int(parms.get("Predictor") or 1)
    if kind == 1:
        return data
    colors, depth, columns = (int(parms.get(k) or d) for k, d in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    step, row = max(1, colors * depth // 8), (colors * depth * columns + 7) // 8
    if kind == 2:
        if depth != 8:
            return data
        n = len(data) // row
        lines = np.frombuffer(data[: n * row], np.uint8).reshape(n, -1, colors)
        return np.cumsum(lines, axis=1, dtype=np.uint8).tobytes() + data[n * row :]
    out, above = bytearray(), np.zeros(row, np.uint8)
    for at in range(0, len(data), row + 1):
        tag, line = data[at], np.frombuffer(data[at + 1 : at + 1 + row].ljust(row, b"\0"), np.uint8)
        if tag == 2:
            now = line + above
        elif tag == 1:
            pad = -row % step
            now = np.cumsum(np.pad(line, (0, pad)).reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:row]
        elif tag in (3, 4):
            now = bytearray(row)
            for i in range(row):
                a, b, c = now[i - step] if i >= step else 0, int(above[i]), int(above[i - step]) if i >= step else 0
                if tag == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    far = (abs(p - a), abs(p - b), abs(p - c))
                    guess = (a, b, c)[far.index(min(far))]
                now[i] = (int(line[i]) + guess) & 255
            now = np.frombuffer(bytes(now), np.uint8)
        else:
            now = line
        out += now.tobytes()
        above = now
    return bytes(out)


# Filter names and their short forms.
FILTERS = {"FlateDecode": flate, "Fl": flate, "ASCII85Decode": ascii85, "A85": ascii85, "ASCIIHexDecode": ascii_hex, "AHx": ascii_hex, "RunLengthDecode": run_length, "RL": run_length, "LZWDecode": lzw, "LZW": lzw}


def decode(data: bytes, filters: list[str], parms: list[dict]) -> bytes:
    for k, name in enumerate(filters):
        p = parms[k] if k < len(parms) else {}
        if name not in FILTERS:
            return data
        f = FILTERS[name]
        data = lzw(data, int(p.get("EarlyChange", 1))) if f is lzw else f(data)
        if f in (flate, lzw):
            data = predict(data, p)
    return data
