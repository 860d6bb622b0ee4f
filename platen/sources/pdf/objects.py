"""Values, the lexer and the object table of a file."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .crypt import Decryption
from .errors import PdfError
from .filters import decode

WHITE, DELIMITERS = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"
_TOKEN_END = re.compile(rb"[\x00\t\n\x0c\r ()<>\[\]{}/%]")
_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
#: The usual forms of strings, keywords, names and whole numbers; all others are read step by step.
_USUAL = re.compile(rb"[\x00\t\n\x0c\r ]*(?:\(([^\\()]*)\)|([A-Za-z'\"*][^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|/([^\x00\t\n\x0c\r ()<>\[\]{}/%#]*+)(?!#)|(-?\d+)(?![\d.]))")
_WORDS = {"true": True, "false": False, "null": None}
_SPECIAL = re.compile(rb"[\\()]")
_NUMBER = re.compile(rb"[+-]*(?:\d+\.?\d*|\.\d+)")
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj\b")
_REFERENCE = re.compile(rb"(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+R(?![A-Za-z0-9])")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
MAX_DEPTH = 100


class Name(str):
    __slots__ = ()


class Keyword(str):
    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int = 0


class Stream:
    __slots__ = ("dict", "raw")

    def __init__(self, dict_: dict, raw: bytes):
        self.dict, self.raw = dict_, raw


END = Keyword("")


class Lexer:
    """Reads values from bytes; whatever is malformed gives a value or is skipped, never an error."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = _SKIP.match(self.data, self.at).end()

    def value(self, refs: bool = True, depth: int = 0):
        data = self.data
        if (m := _USUAL.match(data, self.at)) and (m.lastindex != 4 or not refs):
            self.at = m.end()
            kind, raw = m.lastindex, m[m.lastindex]
            if kind == 1:
                return raw
            if kind == 4:
                return int(raw)
            text = raw.decode("latin-1")
            return Name(text) if kind == 3 else _WORDS[text] if text in _WORDS else Keyword(text)
        self.skip()
        at = self.at
        if at >= len(data):
            return END
        c = data[at : at + 1]
        if c in b"0123456789+-.":
            if refs and c.isdigit() and (m := _REFERENCE.match(data, at)):
                self.at = m.end()
                return Ref(int(m[1]), int(m[2]))
            if m := _NUMBER.match(data, at):
                self.at = m.end()
                text = m[0].lstrip(b"+-")
                sign = -1 if m[0].startswith(b"-") else 1
                return sign * (float(text) if b"." in text else int(text))
            self.at += 1
            while self.at < len(data) and data[self.at : self.at + 1] in b"+-.":
                self.at += 1
            return 0
        if c == b"/":
            m = _TOKEN_END.search(data, at + 1)
            self.at = m.start() if m else len(data)
            raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), data[at + 1 : self.at])
            return Name(raw.decode("latin-1"))
        if c == b"(":
            return self._literal()
        if data[at : at + 2] == b"<<":
            self.at += 2
            return self._dict(refs, depth + 1)
        if c == b"<":
            end = data.find(b">", at)
            end = len(data) if end < 0 else end
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            out = []
            while depth < MAX_DEPTH and (x := self.value(refs, depth + 1)) is not END and x != "]":
                out.append(x)
            return out
        if c in b"]{}":
            self.at += 1
            return Keyword(c.decode())
        if data[at : at + 2] == b">>":
            self.at += 2
            return Keyword(">>")
        if c in b")>":
            self.at += 1
            return self.value(refs, depth)
        m = _TOKEN_END.search(data, at)
        self.at = max(m.start() if m else len(data), at + 1)
        word = data[at : self.at].decode("latin-1")
        return _WORDS.get(word, Keyword(word))

    def _literal(self) -> bytes:
        out, depth, at, data = bytearray(), 1, self.at + 1, self.data
        while m := _SPECIAL.search(data, at):
            out += data[at : m.start()]
            at, c = m.start(), m[0]
            if c == b"\\":
                nxt = data[at + 1 : at + 2]
                if m := re.compile(rb"[0-7]{1,3}").match(data, at + 1):
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                    continue
                if nxt in (b"\r", b"\n"):
                    at += 3 if data[at + 1 : at + 3] == b"\r\n" else 2
                    continue
                out += _ESCAPES.get(nxt, nxt)
                at += 2
                continue
            if c == b"(":
                depth += 1
            elif c == b")":
                depth -= 1
                if not depth:
                    at += 1
                    break
            out += c
            at += 1
        else:
            out += data[at:]
            at = max(at, len(data))
        self.at = at
        return bytes(out)

    def _dict(self, refs: bool, depth: int) -> dict:
        out: dict = {}
        while depth < MAX_DEPTH:
            key = self.value(refs, depth)
            if key is END or key == ">>" and isinstance(key, Keyword):
                break
            if not isinstance(key, Name):
                continue
            mark = self.at
            x = self.value(refs, depth)
            if isinstance(x, Keyword):
                out[str(key)] = None
                if x == ">>" or x is END:
                    break
                if x in ("endobj", "stream"):
                    self.at = mark
                    break
                continue
            out[str(key)] = x
        return out


class Objects:
    """All objects of a file by number; the last definition wins. Streams are found without a cross-reference table."""

    def __init__(self, data: bytes, password: str = ""):
        self.data = data
        self.where = {int(m[1]): (m.end(), int(m[2])) for m in _OBJECT.finditer(data)}
        self.known: dict[int, object] = {}
        self.open: set[int] = set()
        self.decryption: Decryption | None = None
        self.trailer = self._trailer()
        encrypt = self.get(self.trailer.get("Encrypt"))
        if isinstance(encrypt, dict):
            keep = self.trailer["Encrypt"].number if isinstance(self.trailer["Encrypt"], Ref) else -1
            ids = self.get(self.trailer.get("ID")) or [b""]
            encrypt = {k: self.get(v) for k, v in encrypt.items()}
            self.decryption = Decryption(encrypt, ids[0] if isinstance(ids[0], bytes) else b"", password, keep)
            if not self.decryption.ok:
                raise PdfError("PasswordException", "the password is missing or wrong")
            self.known = {k: v for k, v in self.known.items() if k == keep}
        self._expand()

    def _trailer(self) -> dict:
        out: dict = {}
        for m in re.finditer(rb"\btrailer\b", self.data):
            got = Lexer(self.data, m.end()).value()
            if isinstance(got, dict):
                out |= got
        if "Root" not in out:
            for m in re.finditer(rb"/Type\s*/XRef\b", self.data):
                start = self.data.rfind(b"<<", 0, m.start())
                if start >= 0 and isinstance(got := Lexer(self.data, start).value(), dict):
                    out |= {k: got[k] for k in ("Root", "Info", "Encrypt", "ID") if k in got}
        return out

    def _expand(self) -> None:
        for number in list(self.where):
            at = self.where[number][0]
            if b"ObjStm" not in self.data[at : at + 400]:
                continue
            s = self.get(Ref(number))
            if not isinstance(s, Stream) or s.dict.get("Type") != "ObjStm":
                continue
            body, first = self.bytes_of(s), self.get(s.dict.get("First")) or 0
            head = Lexer(body)
            pairs = [(head.value(False), head.value(False)) for _ in range(min(int(self.get(s.dict.get("N")) or 0), 100_000))]
            for n, offset in pairs:
                if isinstance(n, int) and isinstance(offset, int) and (n not in self.where or self.where[n][0] < at):
                    self.known[n] = Lexer(body, first + offset).value()

    def get(self, x):
        """Follows references."""
        for _ in range(20):
            if not isinstance(x, Ref):
                return x
            x = self._load(x.number)
        return None

    def _load(self, number: int):
        if number in self.known:
            return self.known[number]
        if number not in self.where or number in self.open:
            return None
        self.open.add(number)
        at, generation = self.where[number]
        lexer = Lexer(self.data, at)
        x = lexer.value()
        if isinstance(x, dict):
            lexer.skip()
            if self.data.startswith(b"stream", lexer.at):
                x = Stream(x, self._raw(x, lexer.at + 6))
        self.open.discard(number)
        if isinstance(x, Keyword):
            x = None
        if self.decryption:
            x = self._decrypt(x, number, generation)
        self.known[number] = x
        return x

    def _raw(self, d: dict, at: int) -> bytes:
        at += 2 if self.data.startswith(b"\r\n", at) else 1 if self.data[at : at + 1] in b"\r\n" else 0
        n = self.get(d.get("Length"))
        if isinstance(n, int) and 0 <= n and re.compile(rb"\s{0,4}endstream").match(self.data, at + n):
            return self.data[at : at + n]
        end = self.data.find(b"endstream", at)
        end = len(self.data) if end < 0 else end
        raw = self.data[at:end]
        return raw[:-2] if raw.endswith(b"\r\n") else raw[:-1] if raw[-1:] in b"\r\n" else raw

    def _decrypt(self, x, number: int, generation: int):
        if isinstance(x, bytes):
            return self.decryption.string(x, number, generation)
        if isinstance(x, list):
            return [self._decrypt(v, number, generation) for v in x]
        if isinstance(x, dict):
            return {k: self._decrypt(v, number, generation) for k, v in x.items()}
        if isinstance(x, Stream):
            raw = x.raw if x.dict.get("Type") == "XRef" else self.decryption.stream(x.raw, number, generation)
            return Stream(self._decrypt(x.dict, number, generation), raw)
        return x

    def bytes_of(self, s: Stream) -> bytes:
        """A stream's decoded bytes."""
        filters = self.get(s.dict.get("Filter", s.dict.get("F")))
        parms = self.get(s.dict.get("DecodeParms", s.dict.get("DP")))
        filters = filters if isinstance(filters, list) else [filters] if filters else []
        parms = parms if isinstance(parms, list) else [parms]
        parms = [{k: self.get(v) for k, v in p.items()} if isinstance(p, dict) else {} for p in map(self.get, parms)]
        return decode(s.raw, [str(self.get(f)) for f in filters], parms)
