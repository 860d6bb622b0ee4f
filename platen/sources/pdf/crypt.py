"""The standard security handler: RC4 and AES, user and owner passwords."""

from __future__ import annotations

from hashlib import md5, sha256, sha384, sha512

from .aes import Aes

# Fixed value: the padding of passwords.
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for c in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(c ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def hardened(password: bytes, salt: bytes, user: bytes = b"") -> bytes:
    """The hash of revision 6: at least 64 rounds of AES and of the SHA-2 that its output chooses."""
    key, done = sha256(password + salt + user).digest(), 0
    while True:
        made = Aes(key[:16]).encrypt((password + key + user) * 64, key[16:32])
        key = (sha256, sha384, sha512)[sum(made[:16]) % 3](made).digest()
        done += 1
        if done >= 64 and made[-1] <= done - 32:
            return key[:32]


class Decryption:
    """``ok`` says whether the password is the user's or the owner's."""

    def __init__(self, d: dict, file_id: bytes, password: str, own: int):
        self.own, self.d, self.file_id = own, d, file_id
        self.version, self.revision = int(d.get("V") or 0), int(d.get("R") or 2)
        self.of_stream, self.of_string = (self._method(k) for k in ("StmF", "StrF"))
        key = self._long_key(password) if self.revision >= 5 else self._short_key(password)
        self.ok, self.key = key is not None, key or b""

    def _raw(self, name: str) -> bytes:
        value = self.d.get(name)
        return value if isinstance(value, bytes) else b""

    def _method(self, kind: str) -> str:
        """V2, AESV2, AESV3, or None where nothing is encrypted."""
        if self.version < 4:
            return "V2"
        filters = self.d.get("CF")
        named = filters.get(self.d.get(kind) or "Identity") if isinstance(filters, dict) else None
        return str(named.get("CFM") or "None") if isinstance(named, dict) else "None"

    def _long_key(self, password: str) -> bytes | None:
        typed = password.encode("utf-8", "replace")[:127]
        user, owner = self._raw("U"), self._raw("O")
        for entry, wrapped, more in ((user, "UE", b""), (owner, "OE", user[:48])):
            made = (lambda salt: hardened(typed, salt, more)) if self.revision > 5 else (lambda salt: sha256(typed + salt + more).digest())  # noqa: B023
            if len(entry) >= 48 and made(entry[32:40]) == entry[:32]:
                return Aes(made(entry[40:48])).decrypt(self._raw(wrapped)[:32], bytes(16))
        return None

    def _short_key(self, password: str) -> bytes | None:
        length = max(5, min(16, int(self.d.get("Length") or 40) // 8)) if self.version > 1 else 5
        length = 16 if self.version == 4 else length
        typed = (password.encode("latin-1", "replace") + PADDING)[:32]
        return self._from_user(typed, length) or self._from_user(self._user_of_owner(typed, length), length)

    def _from_user(self, typed: bytes, length: int) -> bytes | None:
        seed = typed + self._raw("O")[:32] + (int(self.d.get("P") or 0) & 0xFFFFFFFF).to_bytes(4, "little") + self.file_id
        if self.revision >= 4 and self.d.get("EncryptMetadata") is False:
            seed += b"\xff" * 4
        key = md5(seed).digest()
        for _ in range(50 if self.revision >= 3 else 0):
            key = md5(key[:length]).digest()
        key, user = key[:length], self._raw("U")
        if self.revision == 2:
            return key if rc4(key, PADDING) == user[:32] else None
        made = md5(PADDING + self.file_id).digest()
        for i in range(20):
            made = rc4(bytes(k ^ i for k in key), made)
        return key if made == user[:16] else None

    def _user_of_owner(self, typed: bytes, length: int) -> bytes:
        key = md5(typed).digest()
        for _ in range(50 if self.revision >= 3 else 0):
            key = md5(key).digest()
        found = self._raw("O")[:32]
        for i in range(19, -1, -1) if self.revision >= 3 else (0,):
            found = rc4(bytes(k ^ i for k in key[:length]), found)
        return found

    def _open(self, method: str, data: bytes, number: int, generation: int) -> bytes:
        if number == self.own or method == "None":
            return data
        key = self.key
        if method != "AESV3":
            salt = b"sAlT" if method == "AESV2" else b""
            key = md5(key + number.to_bytes(3, "little") + generation.to_bytes(2, "little") + salt).digest()[: min(16, len(key) + 5)]
        if method == "V2":
            return rc4(key, data)
        if len(key) not in (16, 32) or len(data) < 32:
            return b""
        plain = Aes(key).decrypt(data[16:], data[:16])
        return plain[: -plain[-1]] if 1 <= plain[-1] <= 16 else plain

    def stream(self, data: bytes, number: int, generation: int) -> bytes:
        return self._open(self.of_stream, data, number, generation)

    def string(self, data: bytes, number: int, generation: int) -> bytes:
        return self._open(self.of_string, data, number, generation)
