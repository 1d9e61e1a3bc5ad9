"""Git repositories as tables, read from their files: commits, trees, blobs, the index, and the working tree's state.

A repository is read in one task; many repositories are many tasks (see repositories). Objects are read one by one, so
memory is bounded by the largest of them. The folder of a repository must be reachable from the executors.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
FOLDER, LINK, MODULE = 0o040000, 0o120000, 0o160000


class _Pack:
    """One pack and its index (version 2)."""

    def __init__(self, index: Path):
        self.index, self.data = index.read_bytes(), index.with_suffix(".pack")
        if self.index[:8] != b"\377tOc\0\0\0\2":
            raise ValueError(f"{index} is no pack index of version 2")
        self.count = struct.unpack(">I", self.index[8 + 255 * 4 : 8 + 256 * 4])[0]
        self.names = 8 + 256 * 4

    def offset(self, oid: bytes) -> int | None:
        lo = struct.unpack(">I", self.index[8 + (oid[0] - 1) * 4 : 8 + oid[0] * 4])[0] if oid[0] else 0
        hi = struct.unpack(">I", self.index[8 + oid[0] * 4 : 12 + oid[0] * 4])[0]
        k = bisect_left(range(self.count), oid, lo, hi, key=lambda i: self.index[self.names + 20 * i : self.names + 20 * i + 20])
        if k >= hi or self.index[self.names + 20 * k : self.names + 20 * k + 20] != oid:
            return None
        table = self.names + 24 * self.count
        at = struct.unpack(">I", self.index[table + 4 * k : table + 4 * k + 4])[0]
        if at >> 31:
            large = table + 4 * self.count + 8 * (at & 0x7FFFFFFF)
            return struct.unpack(">Q", self.index[large : large + 8])[0]
        return at


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _patched(base: bytes, delta: bytes) -> bytes:
    """base with the copies and insertions of delta."""
    _, at = _varint(delta, 0)
    _, at = _varint(delta, at)
    out = bytearray()
    while at < len(delta):
        code, at = delta[at], at + 1
        if code < 128:
            out += delta[at : at + code]
            at += code
            continue
        start = size = 0
        for bit in range(7):
            if code >> bit & 1:
                if bit < 4:
                    start |= delta[at] << 8 * bit
                else:
                    size |= delta[at] << 8 * (bit - 4)
                at += 1
        out += base[start : start + (size or 0x10000)]
    return bytes(out)


class Repository:
    def __init__(self, folder: str):
        root = Path(folder.removeprefix("file://"))
        self.work = root
        self.git = root / ".git" if (root / ".git").is_dir() else root
        self.packs = [_Pack(p) for p in sorted((self.git / "objects/pack").glob("*.idx"))]

    def read(self, oid: str) -> tuple[str, bytes]:
        """Kind and content of an object."""
        loose = self.git / "objects" / oid[:2] / oid[2:]
        if loose.is_file():
            head, _, body = zlib.decompress(loose.read_bytes()).partition(b"\0")
            return head.split()[0].decode(), body
        raw = bytes.fromhex(oid)
        for pack in self.packs:
            at = pack.offset(raw)
            if at is not None:
                return self._packed(pack, at)
        raise KeyError(oid)

    def _packed(self, pack: _Pack, at: int) -> tuple[str, bytes]:
        deltas = []
        while True:
            with open(pack.data, "rb") as f:
                f.seek(at)
                head = f.read(64)
                kind, k = head[0] >> 4 & 7, 1
                byte = head[0]
                while byte >= 128:
                    byte, k = head[k], k + 1
                base: tuple[str, int | str] | None = None
                if kind == 6:
                    back, k = head[k] & 127, k + 1
                    while head[k - 1] >= 128:
                        back, k = (back + 1 << 7) | head[k] & 127, k + 1
                    base = ("offset", at - back)
                elif kind == 7:
                    base, k = ("oid", head[k : k + 20].hex()), k + 20
                f.seek(at + k)
                inflate, parts = zlib.decompressobj(), []
                while not inflate.eof and (chunk := f.read(1 << 16)):
                    parts.append(inflate.decompress(chunk))
            body = b"".join(parts)
            if base is None:
                name = KINDS[kind]
                break
            deltas.append(body)
            if base[0] == "oid":
                name, body = self.read(str(base[1]))
                break
            at = int(base[1])
        for delta in reversed(deltas):
            body = _patched(body, delta)
        return name, body

    def resolve(self, name: str = "HEAD") -> str | None:
        """The commit that a name or an id stands for."""
        for _ in range(8):
            if len(name) == 40 and all(c in "0123456789abcdef" for c in name):
                return name
            found = None
            for candidate in (name, f"refs/heads/{name}", f"refs/tags/{name}", f"refs/remotes/{name}"):
                if (self.git / candidate).is_file():
                    found = (self.git / candidate).read_text().strip().removeprefix("ref: ")
                    break
            if found is None and (self.git / "packed-refs").is_file():
                packed = dict(reversed(x.split(" ", 1)) for x in (self.git / "packed-refs").read_text().splitlines() if x and x[0] not in "#^")
                found = next((packed[c] for c in (name, f"refs/heads/{name}", f"refs/tags/{name}") if c in packed), None)
            if found is None:
                return None
            name = found
        return None

    def commit(self, oid: str) -> dict:
        kind, body = self.read(oid)
        while kind == "tag":
            kind, body = self.read(oid := body.split(b"\n", 1)[0].split()[1].decode())
        head, _, message = body.decode("utf-8", "replace").partition("\n\n")
        out: dict = {"oid": oid, "parents": [], "summary": message.split("\n", 1)[0]}
        for line in head.split("\n"):
            key, _, value = line.partition(" ")
            if key == "parent":
                out["parents"].append(value)
            elif key == "tree":
                out["tree"] = value
            elif key in ("author", "committer"):
                who, _, when = value.rpartition("> ")
                name, _, email = who.partition(" <")
                out |= {f"{key}_name": name, f"{key}_email": email, f"{key}_at": int(when.split()[0])}
        return out

    def log(self, start: str = "HEAD", hide: str | None = None, most: int = 0) -> Iterator[dict]:
        """Commits from start back, the newest first, without those that hide reaches; at most `most` of them (0: all)."""
        hidden: set[str] = set()
        if hide and (at := self.resolve(hide)):
            todo = [at]
            while todo:
                if (oid := todo.pop()) not in hidden:
                    hidden.add(oid)
                    todo += self.commit(oid)["parents"]
        first = self.resolve(start)
        known = {first: self.commit(first)} if first and first not in hidden else {}
        seen, given = set(known), 0
        while known and (not most or given < most):
            oid = max(known, key=lambda o: (known[o]["committer_at"], o))
            entry = known.pop(oid)
            yield entry
            given += 1
            for parent in entry["parents"]:
                if parent not in seen and parent not in hidden:
                    seen.add(parent)
                    known[parent] = self.commit(parent)

    def tree(self, oid: str, prefix: str = "") -> Iterator[tuple[str, int, str]]:
        """path, mode, oid of every blob below a tree."""
        _, body = self.read(oid)
        at = 0
        while at < len(body):
            mode, _, rest = body[at : at + 4096].partition(b" ")
            name = rest.partition(b"\0")[0].decode("utf-8", "replace")
            at += len(mode) + 1 + len(rest.partition(b"\0")[0]) + 1
            child, at = body[at : at + 20].hex(), at + 20
            kind = int(mode, 8)
            if kind == FOLDER:
                yield from self.tree(child, f"{prefix}{name}/")
            elif kind != MODULE:
                yield prefix + name, kind, child

    def tree_of(self, name: str = "HEAD") -> dict[str, str]:
        at = self.resolve(name)
        return {p: o for p, _, o in self.tree(self.commit(at)["tree"])} if at else {}

    def index(self) -> dict[str, tuple[str, int]]:
        """path -> (oid, stage) of the index (versions 2 and 3); submodules are left out."""
        file = self.git / "index"
        if not file.is_file():
            return {}
        data = file.read_bytes()
        magic, version, count = struct.unpack(">4sII", data[:12])
        if magic != b"DIRC" or version not in (2, 3):
            raise ValueError(f"index of version {version}")
        out, at = {}, 12
        for _ in range(count):
            mode = struct.unpack(">I", data[at + 24 : at + 28])[0]
            flags = struct.unpack(">H", data[at + 60 : at + 62])[0]
            start = at + 62 + (2 if version == 3 and flags & 0x4000 else 0)
            end = data.index(b"\0", start)
            if mode >> 12 != MODULE >> 12:
                out[data[start:end].decode("utf-8", "replace")] = (data[at + 40 : at + 60].hex(), flags >> 12 & 3)
            at += (end - at + 8) // 8 * 8
        return out

    def staged(self) -> Iterator[tuple[str, str, bytes]]:
        """path, oid, content of the blobs that the index holds and HEAD doesn't; what is deleted has none."""
        head = self.tree_of()
        for path, (oid, stage) in sorted(self.index().items()):
            if stage == 0 and head.get(path) != oid:
                kind, body = self.read(oid)
                if kind == "blob":
                    yield path, oid, body

    def status(self, ignored: tuple[str, ...] = ()) -> Iterator[tuple[str, str, str | None]]:
        """path, status, old path of the working tree against HEAD: added (untracked too), modified, deleted, renamed by content."""
        head, now = self.tree_of(), {}
        for folder, dirs, files in os.walk(self.work):
            dirs[:] = sorted(d for d in dirs if d != ".git" and d not in ignored)
            for name in files:
                file = Path(folder) / name
                body = os.readlink(file).encode() if file.is_symlink() else file.read_bytes()
                now[file.relative_to(self.work).as_posix()] = hashlib.sha1(b"blob %d\0" % len(body) + body).hexdigest()
        gone: dict[str, list[str]] = {}
        for path in sorted(head.keys() - now.keys()):
            gone.setdefault(head[path], []).append(path)
        for path in sorted(now):
            if path not in head:
                same = gone.get(now[path])
                yield (path, "renamed", same.pop(0)) if same else (path, "added", None)
            elif head[path] != now[path]:
                yield path, "modified", None
        for path in sorted(p for rest in gone.values() for p in rest):
            yield path, "deleted", None

    def changes(self, entry: dict) -> Iterator[tuple[str, int, int]]:
        """path, inserted, deleted lines of a commit against its first parent, as a multiset of lines."""
        old = {p: o for p, _, o in self.tree(self.commit(entry["parents"][0])["tree"])} if entry["parents"] else {}
        new = {p: o for p, _, o in self.tree(entry["tree"])}
        for path in sorted(old.keys() | new.keys()):
            if old.get(path) != new.get(path):
                a, b = (self.read(o)[1].splitlines() if (o := side.get(path)) else [] for side in (old, new))
                counts: dict[bytes, int] = {}
                for line in a:
                    counts[line] = counts.get(line, 0) - 1
                for line in b:
                    counts[line] = counts.get(line, 0) + 1
                yield path, sum(n for n in counts.values() if n > 0), -sum(n for n in counts.values() if n < 0)


def when(seconds: int) -> str:
    return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
