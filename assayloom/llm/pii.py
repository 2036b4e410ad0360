"""Personal data: exact patterns, and a character-level BiLSTM with CRF transitions.

The patterns' spans are the base. The network finds what they cannot spell out:
addresses written with "at" and "dot", numbers with other separators or without
"+", addresses of other forms, and keys and passwords (kind secret). It is
trained in numpy from labelled spans: passages of the corpus into which written
forms of every kind are put at known places, beside numbers of other sorts that
are labelled as outside, and with the patterns' own matches.

Every character of every text is read: overlapping windows cover the whole text,
each is decoded with the CRF, and a character takes the tag of the window in
which it stands farther from an edge, so that spans join across windows. Spans
found that way are added where no pattern's span lies.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append

KINDS = ("email", "ip", "card", "phone")
NAMES = (*KINDS, "secret")  # the network's kinds
TAGS = 1 + 2 * len(NAMES)  # outside, then begin and inside of each kind
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' matches, in order of start, then kind.

    An email's local part runs from its run's start, or from the end of the
    match before; a run without a domain fails from each of its places alike, so
    each "@" is tried once and the scan is linear.
    """
    out = []
    if "@" in text:
        done = 0
        for m in _AT.finditer(text):
            a = m.start()
            while a > done and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                out.append((a, m.end(), 0))
                done = m.end()
    if not _MARK.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


WINDOW, OVERLAP = 512, 64
STRIDE = WINDOW - OVERLAP
BATCH = 744  # windows in one pass
TEXT_BYTES = 4 << 20  # of the texts whose windows run together, so that most passes are full


def windows(n: int) -> list[int]:
    """Starts of windows that cover n characters, neighbours sharing OVERLAP."""
    return list(range(0, max(1, n - OVERLAP), STRIDE)) if n else []


CLASSES = 131  # ASCII, Latin, others, padding
_PAD = 130


def _classes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 128, c, 128 + (c > 0x24F)).astype(np.uint8)


def _pack(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Classes (T, B) of windows and their lengths."""
    n = np.array([len(c) for c in parts], np.int64)
    x = np.full((int(n.max()), len(parts)), _PAD, np.int64)
    for k, c in enumerate(parts):
        x[: len(c), k] = c
    return x, n


def _bend(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """x within -1 and 1: tanh of straight lines, one pass over the numbers."""
    return np.clip(x, -1, 1, out=out)


def _gate(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """x within 0 and 1: a sigmoid of straight lines, once x has been scaled by STEEP and moved by a half."""
    return np.clip(x, 0, 1, out=out)


STEEP = np.float32(0.25)  # of a sigmoid at 0


class Tagger:
    """Embedding, one LSTM each way, a linear layer and CRF transitions."""

    def __init__(self, dim: int = 8, hidden: int = 12, seed: int = 11):
        r = np.random.default_rng(seed)
        n = lambda *s: (r.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
        self.h = hidden
        self.p = {"emb": n(CLASSES, dim) * 3, "out": n(2 * hidden, TAGS), "off": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            # gates are input, forget, output, candidate
            self.p |= {f"{d}x": n(dim, 4 * hidden), f"{d}h": n(hidden, 4 * hidden), f"{d}o": np.repeat([0, 1, 0, 0], hidden).astype(np.float32)}

    def _pair(self, name: str) -> np.ndarray:
        """A parameter of both directions, outputs before inputs."""
        return np.stack([self.p[f"f{name}"].T, self.p[f"b{name}"].T])

    def _lstm(self, e: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Hidden states (T, 2, H, B) of both directions, each in its own order, and what the gradient needs; states are 0 outside live (T, B)."""
        h, e = self.h, e.transpose(0, 2, 1)
        x, m = np.stack([e, e[::-1]], axis=1), np.stack([live, live[::-1]], axis=1)[:, :, None]
        pre, wh = self._pair("x") @ x + self._pair("o")[:, :, None], self._pair("h")
        T, _, _, B = pre.shape
        gates, c, tc, out = (np.empty((T, 2, k * h, B), e.dtype) for k in (4, 1, 1, 1))
        hs, cs = np.zeros((2, h, B), e.dtype), np.zeros((2, h, B), e.dtype)
        for t in range(T):
            z, s = wh @ hs + pre[t], gates[t]
            _gate(z[:, : 3 * h] * STEEP + STEEP * 2, s[:, : 3 * h])
            _bend(z[:, 3 * h :], s[:, 3 * h :])
            cs = np.multiply(s[:, h : 2 * h] * cs + s[:, :h] * s[:, 3 * h :], m[t], out=c[t])
            hs = np.multiply(s[:, 2 * h : 3 * h], _bend(cs, tc[t]), out=out[t])
        return out, (x, m, gates, c, tc, out)

    def emissions(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Tag scores (T, K, B) of packed windows, the longest first.

        The same network without the tape. Columns are windows, so that every step
        works on whole rows; [state, letter, 1] meets one matrix of all gates.
        """
        T, B = x.shape
        h, dim = self.h, self.p["emb"].shape[1]
        if (np.diff(n) > 0).any():
            raise ValueError("windows must come in order of length")
        live = (n[None] > np.arange(T)[:, None]).sum(axis=1).tolist()
        steep = np.repeat([STEEP, STEEP, STEEP, 1], h).astype(np.float32)
        letters = np.take(np.ascontiguousarray(self.p["emb"].T), x.ravel(), axis=1).reshape(dim, T, B)
        em = np.empty((T, TAGS, B), np.float32)
        em[:] = self.p["off"][:, None]
        for d, order, out in (("f", range(T), self.p["out"][:h]), ("b", range(T - 1, -1, -1), self.p["out"][h:])):
            w = (np.concatenate([self.p[f"{d}h"], self.p[f"{d}x"], self.p[f"{d}o"][None]]) * steep).T
            w = np.ascontiguousarray(w, np.float32)
            w[: 3 * h, -1] += 0.5
            out = np.ascontiguousarray(out.T, np.float32)
            v, c, g, z = (np.zeros((k, B), np.float32) for k in (h + dim + 1, h, h, 4 * h))
            v[-1] = 1
            hs, add = v[:h], np.empty((TAGS, B), np.float32)
            # products over so many columns stay under the size from which BLAS starts threads
            step = 250_000 // w.size
            for t in order:
                # the windows that have a character here; those of others keep a state of 0
                m = live[t]
                zt, ct, gt, ht, at = z[:, :m], c[:, :m], g[:, :m], hs[:, :m], add[:, :m]
                v[h:-1, :m] = letters[:, t, :m]
                for i in range(0, m, step):
                    np.matmul(w, v[:, i : min(i + step, m)], out=z[:, i : min(i + step, m)])
                _gate(zt[: 3 * h], zt[: 3 * h])
                np.multiply(_bend(zt[3 * h :], gt), zt[:h], out=gt)
                ct *= zt[h : 2 * h]
                ct += gt
                np.multiply(_bend(ct, gt), zt[2 * h : 3 * h], out=ht)
                em[t, :, :m] += np.matmul(out, ht, out=at)
        return em

    def marginals(self, em: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tag probabilities (T, B, K), expected transitions (K, K), and log Z per window, by scaled sums."""
        T, B, K = em.shape
        live = np.arange(T)[:, None] < n[None]
        top = em.max(axis=2)
        e, move = np.exp((em - top[:, :, None]).astype(np.float64)), np.exp(self.p["move"].astype(np.float64))
        a, b, c = np.empty((T, B, K)), np.ones((T, B, K)), np.ones((T, B))
        for t in range(T):
            v = (a[t - 1] @ move if t else 1.0) * e[t]
            c[t] = np.where(live[t], v.sum(axis=1), 1)
            a[t] = np.where(live[t][:, None], v / c[t][:, None], a[t - 1] if t else v)
        for t in range(T - 2, -1, -1):
            b[t] = np.where(live[t + 1][:, None], (e[t + 1] * b[t + 1] / c[t + 1][:, None]) @ move.T, 1)
        ahead = e[1:] * b[1:] / c[1:, :, None] * live[1:, :, None]
        moves = move * (a[:-1].reshape(-1, K).T @ ahead.reshape(-1, K))
        return a * b * live[:, :, None], moves, np.log(c).sum(axis=0) + (top * live).sum(axis=0)

    def open_windows(self, em: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The windows, of scores (T, K, B), the longest first, whose best path may leave "outside"; decode() gives all others 0.

        A path is compared with "outside" throughout by what each stretch of other
        tags gains. Within a kind the moves are the real ones; a move from another
        kind counts as the dearest there is, from the best tag of any. If no
        stretch of a window can gain that way, its best path is "outside".
        """
        T, _, B = em.shape
        move = (self.p["move"] - self.p["move"][0, 0]).astype(em.dtype)
        begin, inside = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
        # into begins from any tag; into insides from tags of other kinds
        any_begin = move[1:, begin].max(axis=0)[:, None]
        foreign = move[1:, inside].copy()
        foreign[np.arange(TAGS - 1), np.arange(TAGS - 1) // 2] = -np.inf
        any_inside = foreign.max(axis=0)[:, None]
        start_begin, start_inside, leave = move[0, begin][:, None], move[0, inside][:, None], move[1:, 0].max()
        stay, on = move[inside, inside][:, None], move[begin, inside][:, None]
        live = (n[None] > np.arange(T + 1)[:, None]).sum(axis=1).tolist()
        most = np.full(B, -np.inf, em.dtype)
        # before the first character no move costs anything
        b, i = np.zeros((len(NAMES), B), em.dtype), np.zeros((len(NAMES), B), em.dtype)
        b += em[0, 1::2] - em[0, 0]
        i += em[0, 2::2] - em[0, 0]
        for t in range(T):
            m, last = live[t], live[t + 1]
            if t:
                b, i = b[:, :m], i[:, :m]
                i += stay
                np.maximum(i, b + on, out=i)
                np.maximum(i, np.maximum(top[:m] + any_inside, start_inside), out=i)
                gain = em[t, 1:, :m] - em[t, 0, :m]
                i += gain[1::2]
                b = np.maximum(top[:m] + any_begin, start_begin)
                b += gain[::2]
            top = np.maximum(b, i).max(axis=0)
            np.maximum(most[:last], top[:last] + leave, out=most[:last])
            np.maximum(most[last:m], top[last:], out=most[last:m])
        # sums in single precision
        return np.flatnonzero(most > -0.05)

    def decode(self, em: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Viterbi tags (T, B) of scores (T, K, B): best scores forwards, and their tags again on the way back."""
        T, K, B = em.shape
        move = self.p["move"]
        best = np.empty((T, K, B), em.dtype)
        best[0] = em[0]
        for t in range(1, T):
            np.add((best[t - 1][:, None, :] + move[:, :, None]).max(axis=0), em[t], out=best[t])
        tags, last = np.zeros((T, B), np.int64), np.zeros(B, np.int64)
        for t in range(T - 1, -1, -1):
            last = np.where(t == n - 1, best[t].argmax(axis=0), (best[t] + move[:, last]).argmax(axis=0))
            tags[t] = np.where(t < n, last, 0)
        return tags

    def _lstm_back(self, dout: np.ndarray, tape: tuple, g: dict) -> np.ndarray:
        """Gradient of the letters (T, B, D) from that of the states (T, 2, H, B); what does not depend on the step after is done for all steps at once."""
        h = self.h
        x, m, gates, c, tc, out = tape
        i, f, o, new = (gates[:, :, k * h : (k + 1) * h] for k in range(4))
        before = lambda v: np.concatenate([np.zeros_like(v[:1]), v[:-1]])
        # what is bent to a bound has no slope
        slope = (np.abs(gates) < 1).astype(gates.dtype)
        slope[:, :, : 3 * h] *= STEEP * (gates[:, :, : 3 * h] > 0)
        slope *= np.concatenate([new, before(c), tc, i], axis=2)
        through = o * (np.abs(c) < 1)
        back = np.ascontiguousarray(self._pair("h").transpose(0, 2, 1))
        dz = np.empty_like(slope)
        dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        for t in range(len(dout) - 1, -1, -1):
            dh = dh + dout[t]
            dc = (dc + dh * through[t]) * m[t]
            np.multiply(slope[t], np.concatenate([dc, dc, dh, dc], axis=1), out=dz[t])
            dh, dc = back @ dz[t], dc * f[t]
        flat = lambda v: v.transpose(1, 2, 0, 3).reshape(2, v.shape[2], -1)
        z = flat(dz)
        for name, v in (("x", flat(x) @ z.transpose(0, 2, 1)), ("h", flat(before(out)) @ z.transpose(0, 2, 1)), ("o", z.sum(axis=2))):
            g[f"f{name}"], g[f"b{name}"] = v[0], v[1]
        de = self._pair("x").transpose(0, 2, 1) @ dz
        return (de[:, 0] + de[::-1, 1]).transpose(0, 2, 1)

    def gradient(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
        e = self.p["emb"][x]
        T, B = x.shape
        live = np.arange(T)[:, None] < n[None]
        both, tape = self._lstm(e, live)
        h = np.concatenate([both[:, 0], both[::-1, 1]], axis=1).transpose(0, 2, 1)
        em = h @ self.p["out"] + self.p["off"]
        p, moves, z = self.marginals(em, n)
        K = TAGS
        hot = (np.eye(K)[y]) * live[:, :, None]
        real = np.zeros((K, K))
        pair = live[1:]
        np.add.at(real, (y[:-1][pair], y[1:][pair]), 1)
        loss = (z.sum() - (em * hot).sum() - (real * self.p["move"]).sum()) / B
        dem = ((p - hot) / B).astype(e.dtype)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["move"] = ((moves - real) / B).astype(e.dtype)
        g["out"] = np.matmul(h.transpose(0, 2, 1), dem).sum(axis=0)
        g["off"] = dem.sum(axis=(0, 1))
        dh = dem @ self.p["out"].T
        dh = dh.transpose(0, 2, 1)
        de = self._lstm_back(np.stack([dh[:, : self.h], dh[::-1, self.h :]], axis=1), tape, g)
        order = np.argsort(x, axis=None, kind="stable")
        kinds, first = np.unique(x.ravel()[order], return_index=True)
        g["emb"][kinds] = np.add.reduceat(de.reshape(T * B, -1)[order], first, axis=0)
        return g, float(loss)


def _luhn_number(r, n: int) -> str:
    body = "".join(map(str, r.integers(0, 10, n - 1)))
    return next(body + str(d) for d in range(10) if _luhn(body + str(d)))


#: What else counts as labelled in passages used for training: (pattern, kind); group 1 is the span. Cards must pass Luhn.
_LABELLED = (
    (re.compile(r"(?<![0-9])([0-9]{4}(?:[\x20./_-]{0,3}[0-9]{4}){3})(?![0-9])"), 2),
    (re.compile(r"(?<![0-9])(\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4})(?![0-9])"), 3),
    (re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key)\"?\s?[=:]\s?[\"']?((?=[^\s\"']*[0-9])[^\s\"',;]{8,})"), 4),
)


def labelled_spans(text: str) -> list[tuple[int, int, int]]:
    """The patterns' matches, and those of _LABELLED that overlap none before them."""
    out = base_spans(text)
    for pattern, kind in _LABELLED:
        for m in pattern.finditer(text):
            if (kind != 2 or _luhn("".join(c for c in m[1] if c.isdigit()))) and not any(m.start(1) < b and a < m.end(1) for a, b, _ in out):
                out.append((m.start(1), m.end(1), kind))
    return sorted(out)


class Writer:
    """Labelled written forms: value() gives (text before, span, text after, kind), other() something that is no personal data."""

    ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    KEYS = ["token", "api_key", "apikey", "api-key", "secret", "password", "passwd", "pwd", "access_token", "client_secret", "auth_token", "private_key", "SECRET_KEY", "API_KEY", "Password", "Token", "db_password"]

    def __init__(self, r: np.random.Generator):
        self.r = r

    def pick(self, x):
        return x[int(self.r.integers(len(x)))]

    def chars(self, alphabet: str, low: int, high: int) -> str:
        return "".join(self.pick(alphabet) for _ in range(int(self.r.integers(low, high + 1))))

    def digits(self, n: int) -> str:
        return "".join(map(str, self.r.integers(0, 10, n)))

    def word(self) -> str:
        return self.chars("abcdefghijklmnopqrstuvwxyz", 2, 9)

    def email(self):
        local = self.pick([self.word(), f"{self.word()}.{self.word()}", f"{self.word()}{self.digits(2)}", f"{self.word()}_{self.word()}"])
        host, top = self.word(), self.pick(["com", "org", "net", "de", "fr", "io", "co.uk", "example", "test"])
        at, dot = self.pick([("@", "."), (" at ", " dot "), (" (at) ", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" AT ", " DOT "), (" @ ", " . ")])
        return "", f"{local}{at}{host}{dot}{top.replace('.', dot)}", "", 0

    def ip(self):
        parts = [str(int(x)) for x in self.r.integers(0, 256, 4)]
        form = int(self.r.integers(6))
        if form == 0:
            return "", ":".join(f"{int(x):x}" for x in self.r.integers(0, 65536, 8)), "", 1
        if form == 1:
            return "", "".join(f"{int(x):x}:" for x in self.r.integers(0, 65536, int(self.r.integers(2, 5)))) + f":{int(self.r.integers(1, 65536)):x}", "", 1
        return "", self.pick([".", ".", "[.]", " . ", "(.)", "[dot]"]).join(parts), self.pick(["", "", ":8080", "/24"]), 1

    def card(self):
        n = _luhn_number(self.r, 16)
        sep = self.pick(["", " ", "-", ".", "  ", "_", "/", " - "])
        return self.pick(["", "", "card ", "card: ", "no. "]), sep.join(n[i : i + 4] for i in range(0, 16, 4)), "", 2

    def phone(self):
        a, b, c = self.digits(3), self.digits(3), self.digits(4)
        form = self.pick([f"+1 ({a}) {b}-{c}", f"+49 {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0049 {a} {b}{c}", f"0{a[:2]}/{b}{c}", f"1-{a}-{b}-{c}", f"0{a[1:]} {b} {c}"])
        return self.pick(["", "", "tel ", "phone: ", "call "]), form, "", 3

    def secret(self):
        value = self.pick([self.chars("0123456789abcdef", 32, 64), self.chars(self.ALNUM, 16, 48), self.chars(self.ALNUM + "_-", 20, 40), self.chars(self.ALNUM + "!#$%&*", 8, 16)])
        form = int(self.r.integers(6))
        if form == 0:
            return "", "AKIA" + self.chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16), "", 4
        if form == 1:
            return self.pick(["Bearer ", "Authorization: Bearer ", "Authorization: Basic "]), value, "", 4
        if form == 2:
            return "", self.pick(["sk-", "sk_live_", "ghp_", "xoxb-", "glpat-"]) + self.chars(self.ALNUM, 20, 40), "", 4
        mark = self.pick(['"', '"', "'", ""])
        return self.pick(self.KEYS) + self.pick([" = ", "=", ": ", ":", " : "]) + mark, value, mark, 4

    def value(self):
        return self.pick([self.email, self.ip, self.card, self.phone, self.secret, self.secret])()

    def other(self) -> str:
        d = self.digits
        return self.pick([
            f"20{d(2)}-0{d(1)}-1{d(1)}", f"1{d(1)}.0{d(1)}.20{d(2)}", f"{d(2)}:{d(2)}", f"{d(1)},{d(3)},{d(3)}", f"${d(2)}.{d(2)}", f"{d(1)}.{d(2)}.{d(1)}", f"v{d(1)}.{d(1)}", f"{d(4)}", f"{d(6)}", f"no. {d(5)}", f"#{self.chars('0123456789abcdef', 6, 6)}",
            f"@{self.word()}", f"page {d(3)}-{d(3)}", f"{d(1)} at {d(2)}", f"a dot and {self.word()} at noon", f"{d(3)}%", f"{d(1)}/{d(2)}", f"token {self.word()}", f"the password {self.word()} was", f"secret: {self.word()} {self.word()}", f'key = "{self.word()}"', f"{self.word().upper()} {self.word().upper()}", f"{self.word().upper()}{self.pick(['!!', '!', '###', '$$$', '&&&', '%%%'])} {self.word().upper()}!!",
            f"id {d(7)}", f"{self.word()}-{self.word()}-{d(2)}", f"{d(8)}", f"http://{self.word()}.com/{self.word()}", f"{d(1)}e-{d(2)}", f"[{d(2)}]", f"({d(4)})", f"{self.word()}{d(3)}", f"{self.word()}. " * int(self.r.integers(2, 20)), f"{self.pick([self.word(), self.word().title(), 'at', 'to', 'At', 'dot'])} " * int(self.r.integers(3, 60)), f"{self.word()} " * int(self.r.integers(3, 30)), f"{self.word()}{self.pick(['. ', ', ', '! '])}" * int(self.r.integers(3, 30)), f"{self.word()}@{self.word()}", "!" * int(self.r.integers(2, 9)),
        ])

    def passage(self, text: str, most: int = 4) -> tuple[str, list[tuple[int, int, int]]]:
        """text with up to most values and as many other things put in at word ends, and the labelled spans of it: the values and labelled_spans() outside them."""
        gaps = [i for i, c in enumerate(text) if c in " \n"] or [len(text)]
        at = sorted({self.pick(gaps) for _ in range(int(self.r.integers(1, 2 * most + 1)))})
        out, spans, done, n = [], [], 0, 0
        for i in at:
            out.append(text[done:i] + " ")
            n += i - done + 1
            if self.r.random() < 0.5:
                make = self.pick([self.email, self.ip, self.card, self.phone, self.secret, self.secret])
                put = ""
                # values of one kind may be neighbours
                for k in range(self.pick([1, 1, 1, 1, 2, 3])):
                    before, value, after, kind = make()
                    put += (self.pick([" ", " ", ", ", "\n", "; ", " / "]) if k else "") + before
                    spans.append((n + len(put), n + len(put) + len(value), kind))
                    put += value + after
            else:
                put = self.other()
            put += self.pick(["", "", "", ".", ",", ";", ")"])
            out.append(put)
            n, done = n + len(put), i
        whole = "".join(out) + text[done:]
        spans += [s for s in labelled_spans(whole) if not any(s[0] < b and a < s[1] for a, b, _ in spans)]
        spans.sort()
        free = [s for k, s in enumerate(spans) if not k or s[0] >= spans[k - 1][1]]
        return whole, free


def _tags(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for a, b, k in spans:
        y[a], y[a + 1 : b] = 1 + 2 * k, 2 + 2 * k
    return y


def _stretches(y: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) of a text's tags: a span starts at each begin, and where a kind comes after outside or another kind."""
    kind = (y + 1) // 2
    cut = np.flatnonzero((np.diff(kind, prepend=0) != 0) | (y % 2 == 1))
    ends = np.append(cut[1:], len(y))
    return [(int(a), int(b), int(kind[a]) - 1) for a, b in zip(cut, ends) if kind[a]]


def train(texts: list[str], spans: list[list[tuple[int, int, int]]], steps: int = 1000, batch: int = 128, rate: float = 0.02, seed: int = 11, span: int = 96) -> Tagger:
    """Adam on the CRF's likelihood over stretches of span characters of the labelled texts; the same input gives the same network."""
    net, r = Tagger(seed=seed), np.random.default_rng(seed)
    code, tags = [_classes(t) for t in texts], [_tags(len(t), s) for t, s in zip(texts, spans)]
    pool = [(k, a) for k, t in enumerate(texts) for a in range(0, max(1, len(t) - span // 2), span // 2) if t]
    if not pool:
        return net
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    for t in range(1, steps + 1):
        pick = [pool[i] for i in r.integers(0, len(pool), batch)]
        x, n = _pack([code[k][a : a + span] for k, a in pick])
        y = np.zeros_like(x)
        for j, (k, a) in enumerate(pick):
            y[: n[j], j] = tags[k][a : a + span]
        g, _ = net.gradient(x, n, y)
        norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
        lr = rate * (1 - 0.95 * t / steps)
        for k in net.p:
            q = g[k] * min(1.0, 5.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * q
            v[k] = 0.999 * v[k] + 0.001 * q * q
            net.p[k] -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def model_spans(net: Tagger, texts: list[str], sure: float = 0.9) -> list[list[tuple[int, int, int]]]:
    """Spans of the network's global tags that are on average at least sure and nowhere less than half. Windows of all texts run together, those of like length in one pass."""
    code = [_classes(t) for t in texts]
    todo = sorted(((k, a) for k, c in enumerate(code) for a in windows(len(c))), key=lambda w: (-min(WINDOW, len(code[w[0]]) - w[1]), w))
    found: dict[int, list] = {}

    def search(held):
        part, n = [w for p, _, _ in held for w in p], np.concatenate([n for _, n, _ in held])
        em = np.zeros((int(n.max()), TAGS, len(part)), np.float32)
        done = 0
        for _, _, e in held:
            em[: len(e), :, done : done + e.shape[2]] = e
            done += e.shape[2]
        tags = net.decode(em, n)
        some = np.flatnonzero(((tags > 0) & (np.arange(len(tags))[:, None] < n)).any(axis=0))
        if not len(some):
            return
        p = net.marginals(np.ascontiguousarray(em[:, :, some].transpose(0, 2, 1)), n[some])[0]
        for j, q in zip(some.tolist(), np.moveaxis(p, 1, 0)):
            k, a = part[j]
            found.setdefault(k, []).append((a, tags[: n[j], j], q[np.arange(n[j]), tags[: n[j], j]]))

    held = []
    for i in range(0, len(todo), BATCH):
        part = todo[i : i + BATCH]
        x, n = _pack([code[k][a : a + WINDOW] for k, a in part])
        em = net.emissions(x, n)
        some = net.open_windows(em, n)
        if len(some):
            held.append(([part[j] for j in some.tolist()], n[some], em[: n[some[0]]][:, :, some]))
        if held and (sum(len(h[0]) for h in held) >= BATCH // 2 or i + BATCH >= len(todo)):
            search(held)
            held = []
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, got in found.items():
        y, q = np.zeros(len(code[k]), np.int64), np.ones(len(code[k]))
        for a, tags, p in got:
            # from the middle of the stretch shared with the window before to that shared with the next
            lo = OVERLAP // 2 if a else 0
            hi = len(tags) if a + len(tags) == len(y) else len(tags) - OVERLAP // 2
            y[a + lo : a + hi], q[a + lo : a + hi] = tags[lo:hi], p[lo:hi]
        out[k] = [(b, e, kind) for b, e, kind in _stretches(y) if q[b:e].mean() >= sure and q[b:e].min() >= min(sure, 0.5)]
    return out


def all_spans(net: Tagger, texts: list[str]) -> tuple[list, list]:
    """Each text's pattern spans, and all spans: those and the network's that overlap none of them."""
    base = [base_spans(t) for t in texts]
    every = []
    for b, extra in zip(base, model_spans(net, texts)):
        free = [s for s in extra if not any(s[0] < e and a < s[1] for a, e, _ in b)]
        every.append(sorted(b + free, key=lambda s: (s[0], s[2], s[1])))
    return base, every


def sample_passages(docs: DataFrame, sample: int, passage: int) -> list[str]:
    """At most 2 * sample passages of the texts: sample of any, and sample of those with a digit or "@", from near their first one.

    Texts are picked by a hash, and any text may be, however long; a hash also
    says where in the text its passage of at most passage characters starts.
    """
    d = docs.select("text").where("text <> ''").withColumn("k", F.md5("text"))
    out = []
    for rows, start in (
        (d, F.pmod(F.xxhash64("k"), F.greatest(F.length("text") - passage, F.lit(1)).cast("long"))),
        (d.where(F.col("text").rlike("[0-9@]")), F.greatest(F.regexp_instr("text", F.lit("[0-9@]")) - F.pmod(F.xxhash64("k"), F.lit(passage // 2)), F.lit(0))),
    ):
        # the hashes first: at most sample of them a task, and no texts, are ordered
        picked = rows.select("k").distinct().orderBy("k").limit(sample)
        cut = rows.join(F.broadcast(picked), "k").select("k", F.substring("text", (start + 1).cast("int"), F.lit(passage)).alias("t"))
        out += sorted(r[0] for r in cut.groupBy("k").agg(F.first("t")).select("first(t)").collect())
    return out


def fit(docs: DataFrame, sample: int = 300, passage: int = 1500, copies: int = 3, seed: int = 5, **how) -> Tagger:
    """Train on labelled spans: sample_passages() of docs (text), each written copies times with labelled values of every kind put in.

    sample and passage bound what the driver holds. A table without texts trains
    on the written forms alone; null texts take no part, and other columns none.
    """
    write = Writer(np.random.default_rng(seed))
    texts = sample_passages(docs, sample, passage) or ["a b c"] * sample
    got = [write.passage(t) for t in texts for _ in range(copies)]
    # texts of a word or two, too, as they have no context
    got += [(t, labelled_spans(t)) for x in texts for t in (" ".join(x.split()[:2]), x[-12:], x.split()[-1].upper() + "!!" if x.split() else "")]
    return train([t for t, _ in got], [s for _, s in got], **how)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{NAMES[k]}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, net: Tagger) -> DataFrame:
    """docs (text, ...) with n_email, n_ip, n_card, n_phone (patterns' spans), base_sha256 and spans.

    Null texts are empty: no spans, and the hash of the empty string. Rows are
    taken one by one, whatever their number, ties or other columns, which stay;
    columns with the new names are replaced. An empty table gives no rows.
    """

    def make(texts):
        base, every = all_spans(net, texts)
        counts = [pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
        return [*counts, pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base]), pa.array([written(e) for e in every])]

    return append(docs, make, [*[(f"n_{k}", "long") for k in KINDS], ("base_sha256", "string"), ("spans", "string")], TEXT_BYTES)


def redact(docs: DataFrame, net: Tagger) -> DataFrame:
    """docs (text, ...) with each found span replaced by its kind in angle brackets; overlapping spans as one.

    Null texts stay null, texts without spans stay as they are, and so do all
    other columns; rows that agree are treated alike.
    """

    def make(texts):
        out = []
        for t, spans in zip(texts, all_spans(net, texts)[1]):
            parts, done = [], 0
            for a, b, k in spans:
                if a >= done:
                    parts += [t[done:a], f"<{NAMES[k]}>"]
                done = max(done, b)
            out.append("".join(parts) + t[done:])
        return [pa.array(out)]

    was = docs.withColumn("_null_text", F.col("text").isNull())
    return append(was, make, [("text", "string")], TEXT_BYTES).withColumn("text", F.when(~F.col("_null_text"), F.col("text"))).select(*docs.columns)
