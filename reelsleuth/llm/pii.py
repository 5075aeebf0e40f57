"""Personal data: exact patterns, and a character-level bidirectional LSTM with a CRF that adds what they miss."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Tags: 0 is outside, 1 + 2k begins kind k and 2 + 2k goes on with it.
TAGS = 1 + 2 * len(KINDS)
#: Characters of a window, and between the starts of windows: neighbours share WINDOW - STRIDE characters.
WINDOW, STRIDE = 320, 288
#: Characters that a step of the LSTM reads, an even number.
PER = 2
#: Characters of a text to learn from.
LEARN = 112
#: Hidden units of a direction; and windows that step together.
HIDDEN, AT_ONCE = 8, 1024
#: Characters of the texts that are held at once, a long text apart.
SLICE = 1_000_000
#: Windows that are decoded together at most, but for spans that cross their border.
REGION = 8192
#: Character codes: ASCII, other letters, the rest.
CODES = 130

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def is_ip(s: str) -> bool:
    return all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in s.split("."))


def is_card(s: str) -> bool:
    digits = NOT_DIGIT.sub("", s)
    return 14 <= len(digits) <= 19 and luhn(digits)


def is_phone(s: str) -> bool:
    return 10 <= len(NOT_DIGIT.sub("", s)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the exact patterns find, by start, then kind."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:  # a match begins at the longest run of local characters before its @
        first = at
        while first > done and (c := text[first - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
            first -= 1
        if first < at and (m := DOMAIN.match(text, at)):
            out.append((first, 0, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    for kind, pattern, passes in ((1, IP, is_ip), (2, CARD, is_card), (3, PHONE, is_phone)):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if passes(m.group())]
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# --- The model -------------------------------------------------------------------------------------------


def codes(text: str) -> np.ndarray:
    """ASCII characters by themselves, other letters as 128, the rest as 129. Padding is 0."""
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(raw < 128, raw, np.where(raw < 0x2000, 128, 129)).astype(np.int16)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _slope(z: np.ndarray, low: float) -> np.ndarray:
    """Slope of a line clipped to low..1."""
    return ((z > low) & (z < 1)).astype(np.float32)


class Tagger:
    """BiLSTM-CRF in numpy, single precision. A step of the LSTM reads PER characters and all windows of a batch step together;
    each character has tags and emissions of its own.

    Gates are lines clipped to 0..1, candidates and cells lines clipped to -1..1, which cost a fraction of exponentials.
    """

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.w = {}
        for d in "fb":
            scale = np.repeat([0.25, 1.0], [3 * h, h])  # a gate's line is as steep as a sigmoid
            self.w[f"x{d}"] = rng.normal(0, 0.3, (PER, CODES, 4 * h)) * scale
            self.w[f"u{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h)) * scale
            bias = np.zeros(4 * h)
            bias[: 3 * h] = 0.5
            bias[h : 2 * h] = 0.8
            self.w[f"c{d}"] = bias
        self.w["out"] = rng.normal(0, 0.3, (2 * h, PER * TAGS))
        self.w["own"] = np.zeros((CODES, TAGS))
        self.w["out0"] = np.zeros(PER * TAGS)
        self.w["next"] = np.zeros((TAGS, TAGS))
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        # An inside tag follows the begin or inside tag of its own kind alone.
        self.barred = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(KINDS)):
            for t in range(TAGS):
                if t not in (1 + 2 * k, 2 + 2 * k):
                    self.barred[t, 2 + 2 * k] = -1e4
        self.prepare()

    def prepare(self) -> None:
        """What each pair of characters adds to gates and emissions, and all against outside's; to be called after weights change."""
        def pairs(x: np.ndarray, bias=0.0) -> list[np.ndarray]:
            tables = [(x[k][:, None] + x[k + 1][None]).reshape(CODES * CODES, -1) for k in range(0, PER, 2)]
            tables[0] += bias
            return tables

        self.w_pair = {d: pairs(self.w[f"x{d}"], self.w[f"c{d}"]) for d in "fb"}
        rel = lambda w: ((w := w.reshape(-1, PER, TAGS)) - w[..., :1]).reshape(-1, PER * TAGS)
        self.w_rel, self.w_rel0, own = rel(self.w["out"]), rel(self.w["out0"])[0], self.w["own"] - self.w["own"][:, :1]
        self.own_pair = np.concatenate(np.broadcast_arrays(own[:, None], own[None]), axis=2).reshape(CODES * CODES, -1)
        trans = self.w["next"] + self.barred
        self.trans = trans - trans[0, 0]
        self.bonus = float(self.trans[:, 1:].max() + max(0.0, self.trans[1:, 0].max()))

    def _lstm(self, pairs: np.ndarray, d: str, keep: bool):
        """Hidden states (S, B, H) over pairs of characters (S, PER / 2, B), backwards for d = b; with what gradients need if `keep`."""
        h, (steps, _, b) = HIDDEN, pairs.shape
        (table, *others), u = self.w_pair[d], self.w[f"u{d}"]
        hs, c, now = np.empty((steps, b, h), np.float32), np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
        low = np.repeat(np.array([0, -1], np.float32), [3 * h, h])
        zu, made, kept = np.empty((b, 4 * h), np.float32), np.empty((b, h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = table[pairs[t, 0]]
            for k, other in enumerate(others, 1):
                z += other[pairs[t, k]]
            z += np.matmul(now, u, out=zu)
            if keep:
                kept.append([t, z.copy(), c.copy(), now])
            np.minimum(z, 1, out=z)
            np.maximum(z, low, out=z)
            c *= z[:, h : 2 * h]
            np.multiply(z[:, :h], z[:, 3 * h :], out=made)
            c += made
            if keep:
                kept[-1] += [z, c.copy()]
            np.minimum(c, 1, out=c)
            np.maximum(c, -1, out=c)
            now = np.multiply(c, z[:, 2 * h : 3 * h], out=hs[t])
        return hs, kept

    def hidden(self, x: np.ndarray, keep: bool = False):
        """Pairs of characters, states of both directions (S, B, 2 H) over codes (T, B), T a multiple of PER, and what gradients need."""
        pairs = (x[0::2].astype(np.int32) * CODES + x[1::2]).reshape(-1, PER // 2, x.shape[1])
        f, kf = self._lstm(pairs, "f", keep)
        b, kb = self._lstm(pairs, "b", keep)
        return pairs, np.concatenate((f, b), axis=2), kf, kb

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(T, TAGS, B) over codes (T, B), against outside's."""
        pairs, both, _, _ = self.hidden(x)
        e = np.matmul(both, self.w_rel)
        e += self.w_rel0
        for k in range(PER // 2):
            e[..., 2 * k * TAGS : 2 * (k + 1) * TAGS] += self.own_pair[pairs[:, k]]
        return np.ascontiguousarray(e.transpose(0, 2, 1)).reshape(len(x), TAGS, x.shape[1])

    def loss_and_grad(self, x: np.ndarray, y: np.ndarray):
        """Mean negative log likelihood of tags y (T, B) by the CRF and, half as much, of each tag by itself; and gradients.

        The second part keeps emissions of ordinary text below that of outside, so that most of it needs no decoding.
        """
        t_all, b = x.shape
        self.prepare()
        pairs, both, kf, kb = self.hidden(x, keep=True)
        e = (both.reshape(-1, 2 * HIDDEN) @ self.w["out"] + self.w["out0"]).reshape(len(pairs), b, PER, TAGS)
        e = e.transpose(0, 2, 1, 3).reshape(t_all, b, TAGS) + self.w["own"][x]
        trans = self.w["next"] + self.barred
        alpha = np.empty_like(e)
        alpha[0] = e[0] + np.array([0] + [0, -1e4] * len(KINDS), np.float32)
        for t in range(1, t_all):
            alpha[t] = e[t] + _lse(alpha[t - 1][:, :, None] + trans[None], 1)
        beta = np.zeros_like(e)
        for t in range(t_all - 2, -1, -1):
            beta[t] = _lse(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _lse(alpha[-1], 1)
        gold = np.take_along_axis(e, y[..., None], 2)[..., 0].sum(0) + trans[y[:-1], y[1:]].sum(0)
        de = np.exp(alpha + beta - z[None, :, None])
        dn = np.exp(alpha[:-1][..., None] + trans + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]).sum((0, 1))
        np.add.at(dn, (y[:-1].ravel(), y[1:].ravel()), -1)
        np.put_along_axis(de, y[..., None], np.take_along_axis(de, y[..., None], 2) - 1, 2)
        alone = np.exp(e - _lse(e, 2)[..., None])
        np.put_along_axis(alone, y[..., None], np.take_along_axis(alone, y[..., None], 2) - 1, 2)
        de = (de + 0.5 * alone) / b
        g = {"next": dn / b}
        steps = t_all // PER
        flat = de.reshape(steps, PER, b, TAGS).transpose(0, 2, 1, 3).reshape(-1, PER * TAGS)
        g["out"], g["out0"] = both.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(0)
        hot = np.zeros((PER, steps * b, CODES), np.float32)
        for k in range(PER):
            hot[k, np.arange(steps * b), x[k::PER].ravel()] = 1
        g["own"] = sum(hot[k].T @ de[k::PER].reshape(-1, TAGS) for k in range(PER))
        dboth = (flat @ self.w["out"].T).reshape(both.shape)
        h = HIDDEN
        for d, kept, dh_all in (("f", kf, dboth[..., :h]), ("b", kb, dboth[..., h:])):
            u, gu = self.w[f"u{d}"], np.zeros_like(self.w[f"u{d}"])
            dzs = np.empty((steps, b, 4 * h), np.float32)
            dh, dc = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
            for t, raw, before, was, act, cell in reversed(kept):
                i, f, o, cand = act[:, :h], act[:, h : 2 * h], act[:, 2 * h : 3 * h], act[:, 3 * h :]
                dh = dh + dh_all[t]
                dc = (dc + dh * o) * _slope(cell, -1)
                dz = np.concatenate((dc * cand, dc * before, dh * np.clip(cell, -1, 1), dc * i), axis=1)
                dz[:, : 3 * h] *= _slope(raw[:, : 3 * h], 0)
                dz[:, 3 * h :] *= _slope(raw[:, 3 * h :], -1)
                gu += was.T @ dz
                dzs[t] = dz
                dh, dc = dz @ u.T, dc * f
            flat = dzs.reshape(-1, 4 * h)
            g |= {f"x{d}": np.stack([hot[k].T @ flat for k in range(PER)]), f"u{d}": gu, f"c{d}": flat.sum(0)}
        return float((z - gold).mean()), g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01) -> None:
        """Adam over shuffled batches of columns, the rate falling to nothing."""
        rng = np.random.default_rng(11)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, steps = 0, epochs * (x.shape[1] // batch)
        for _ in range(epochs):
            order = rng.permutation(x.shape[1])
            for at in range(0, len(order) - batch + 1, batch):
                _, g = self.loss_and_grad(x[:, order[at : at + batch]], y[:, order[at : at + batch]])
                step += 1
                norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                for k, a in g.items():
                    a = a * min(1.0, 5 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v2[k] = 0.99 * v2[k] + 0.01 * a * a
                    self.w[k] -= (rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        self.prepare()

    def wins(self, e: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """Whether a span may gain on outside in each window, from emissions(); `opens`: windows that begin a text.

        Scores of the best begin and inside tag of each kind, transitions into outside and into begin tags taken at their
        best; a window's first place may go on with a span and its last place may end one, for neighbours hold the rest.
        """
        begin, inside, trans = e[:, 1::2], e[:, 2::2], self.trans
        enter, again, leave = trans[0, 1::2, None], trans[1:, 1::2].max(0)[:, None], float(trans[1:, 0].max())
        go, on = np.diagonal(trans[1::2, 2::2])[:, None], np.diagonal(trans[2::2, 2::2])[:, None]
        s_begin, s_in = begin[0] + enter, np.where(opens, np.float32(-1e4), inside[0])
        most = np.maximum(s_begin, s_in).max(0)
        best = most.copy()
        for t in range(1, len(e)):
            s_in = np.maximum(s_begin + go, s_in + on) + inside[t]
            s_begin = np.maximum(enter, most + again) + begin[t]
            most = np.maximum(s_begin, s_in).max(0)
            np.maximum(best, most, out=best)
        return best + leave > 0

    def best_path(self, e: np.ndarray) -> np.ndarray:
        """Best tags (T, B) for emissions (T, B, TAGS), with outside before and after."""
        score, back = e[0] + self.trans[0], np.zeros(e.shape, np.int8)
        for t in range(1, len(e)):
            both = score[:, None, :] + self.trans.T
            back[t] = both.argmax(2)
            score = np.take_along_axis(both, back[t][..., None].astype(np.int64), 2)[..., 0] + e[t]
        tags, each = np.empty(e.shape[:2], np.int64), np.arange(e.shape[1])
        tags[-1] = (score + self.trans[:, 0]).argmax(1)
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = back[t, each, tags[t]]
        return tags


def windows_at(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Codes (WINDOW, B) of the windows that begin at `starts`; 0 from the text's end on."""
    at = starts[None, :] + np.arange(WINDOW)[:, None]
    return np.where(at < ends[None, :], code[np.minimum(at, len(code) - 1)], 0)


#: How much a window says about each of its places: less towards its edges, where it lacks context.
RAMP = np.minimum(np.minimum(np.arange(WINDOW) + 1, np.arange(WINDOW, 0, -1)), WINDOW - STRIDE).astype(np.float32)


def _merged(e: np.ndarray, size: int) -> np.ndarray:
    """Emissions of the `size` places that neighbouring windows (WINDOW, TAGS, k) cover, overlaps averaged."""
    total, weight = np.zeros((size + WINDOW, TAGS), np.float32), np.zeros(size + WINDOW, np.float32)
    for k in range(e.shape[2]):
        at = slice(k * STRIDE, k * STRIDE + WINDOW)
        total[at] += e[:, :, k] * RAMP[:, None]
        weight[at] += RAMP
    return total[:size] / weight[:size, None]


def _open(gain: np.ndarray) -> np.ndarray:
    """Places that a run of positive total gain holds; elsewhere outside is best whatever the run."""
    c = np.cumsum(gain)
    ending = c - np.minimum.accumulate(np.concatenate(([0.0], c[:-1])))
    beginning = np.maximum.accumulate(c[::-1])[::-1] - np.concatenate(([0.0], c[:-1]))
    return ending + beginning - gain > 0


def _decode(tagger: Tagger, parts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of the best path over each part's emissions (T, TAGS), with outside before and after.

    Only stretches that may gain on outside are run, many of like length at once.
    """
    cuts = []
    for j, e in enumerate(parts):
        is_open = _open(e[:, 1:].max(1).astype(np.float64) + tagger.bonus)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], is_open.view(np.int8), [0]))))
        cuts += [(t - s, j, s) for s, t in zip(edge[::2].tolist(), edge[1::2].tolist())]
    out: list[list] = [[] for _ in parts]
    cuts.sort()
    for at in range(0, len(cuts), 256):
        some = cuts[at : at + 256]
        e = np.full((some[-1][0], len(some), TAGS), -1e4, np.float32)
        e[..., 0] = 0
        for c, (n, j, s) in enumerate(some):
            e[:n, c] = parts[j][s : s + n]
        tags = tagger.best_path(e)
        for b, c in zip(*(tags % 2 == 1).nonzero()):
            n, j, s = some[c]
            kind, stop = int(tags[b, c] // 2), int(b) + 1
            while stop < n and tags[stop, c] == 2 + 2 * kind:
                stop += 1
            out[j].append((s + int(b), kind, s + stop))
    return out


def tagged(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of the spans that the model finds in each text, by start.

    All windows of all texts are run and scored by the CRF. Where a window may hold a span, or a part of one, emissions of it and
    its neighbours are averaged where they overlap, and the CRF decodes them as one sequence, which grows until outside
    surrounds what it finds. So a span may have any length and lie anywhere.
    """
    found: list[list] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return found
    code = np.concatenate([codes(texts[j]) for j in some])
    ends = np.cumsum(sizes[some])
    begins = ends - sizes[some]
    many = np.maximum(1, -(-(sizes[some] - (WINDOW - STRIDE)) // STRIDE))
    text_of = np.repeat(np.arange(len(some)), many)
    number = np.arange(len(text_of)) - np.repeat(np.cumsum(many) - many, many)
    starts, stops, live = begins[text_of] + STRIDE * number, ends[text_of], np.zeros(len(text_of), bool)
    known: dict[int, np.ndarray] = {}  # emissions of live windows
    for at in range(0, len(starts), AT_ONCE):
        e = tagger.emissions(windows_at(code, starts[at : at + AT_ONCE], stops[at : at + AT_ONCE]))
        for k in np.flatnonzero(tagger.wins(e, number[at : at + AT_ONCE] == 0)).tolist():
            live[at + k] = True
            known[at + k] = e[:, :, k].copy()
    first_of = np.cumsum(many) - many
    # Neighbouring live windows are decoded together, REGION at a time.
    at = np.flatnonzero(live)
    apart = (text_of[at[1:]] != text_of[at[:-1]]) | (np.diff(at) > 1) | (at[1:] // REGION != at[:-1] // REGION)
    todo = [(int(part[0]), int(part[-1]), int(text_of[part[0]])) for part in np.split(at, np.flatnonzero(apart) + 1) if len(part)]
    while todo:
        lacking = np.array(sorted({k for a, b, _ in todo for k in range(a, b + 1)} - known.keys()), np.int64)
        for i in range(0, len(lacking), AT_ONCE):
            part = lacking[i : i + AT_ONCE]
            e = tagger.emissions(windows_at(code, starts[part], stops[part]))
            known |= {k: e[:, :, c].copy() for c, k in enumerate(part.tolist())}
        wider = []
        parts = [_merged(np.stack([known[k] for k in range(a, b + 1)], axis=2), min(int(starts[b]) + WINDOW, int(ends[t])) - int(starts[a])) for a, b, t in todo]
        for (a, b, t), part, spans in zip(todo, parts, _decode(tagger, parts)):
            place, begin = int(starts[a]), int(begins[t])
            # Where a span lies in what a neighbour sees too, the neighbour is heard.
            head, tail = int(first_of[t]), int(first_of[t] + many[t]) - 1
            left = a > head and any(s < WINDOW - STRIDE for s, _, _ in spans)
            right = b < tail and any(e > len(part) - (WINDOW - STRIDE) for _, _, e in spans)
            if left or right:
                wider.append((max(head, a - (b - a + 1) * left), min(tail, b + (b - a + 1) * right), t))
            else:
                found[int(some[t])] += [(place - begin + s, kind, place - begin + e) for s, kind, e in spans]
        todo = wider
    return [sorted(set(f)) for f in found]


# --- Labelled spans to learn from -------------------------------------------------------------------------


class _Random(random.Random):
    def integers(self, low: int, high: int, n: int | None = None):
        return self.randrange(low, high) if n is None else self.choices(range(low, high), k=n)

    def choice(self, seq, n: int | None = None, p=None):
        return self.choices(seq, weights=p)[0] if n is None else self.choices(seq, k=n)


def _syllables(rng, vowels: str) -> str:
    clusters = lambda most: "".join(rng.choice("bcdfghjklmnpqrstvwxyz", rng.integers(0, most + 1)))
    return "".join(clusters(2) + rng.choice(vowels) + clusters(1) for _ in range(rng.integers(1, 5)))


#: Short words of ordinary text, some of them parts of spelled-out addresses.
SHORT = ("at", "dot", "a", "the", "to", "of", "and", "that", "on", "is", "de", "en", "la", "el", "un", "und", "der", "mat", "hat", "rot", "point", "com", "org")


def _word(rng) -> str:
    return rng.choice(SHORT) if rng.random() < 0.2 else _syllables(rng, "aeiouaeiouaeiouyáéíóúüöäñçèêàß")


def _name(rng) -> str:
    return _syllables(rng, "aeiou")[:12]


def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _card(rng) -> str:
    body = _digits(rng, int(rng.choice([13, 14, 15, 15, 15, 18])))
    last = next(d for d in "0123456789" if luhn(body + d))
    full = body + last
    sep = rng.choice(["", " ", "-", ".", "/", "  ", " - "])
    return sep.join(full[i : i + 4] for i in range(0, len(full), 4))


def _entity(rng, kind: int) -> str:
    if kind == 0:
        dotted = rng.choice([".", " (dot) ", "(dot)", "[dot]", " [dot] ", "{dot}", " . "], p=[0.55, 0.12, 0.08, 0.08, 0.08, 0.05, 0.04])
        at = "@" if dotted == "." and rng.random() < 0.6 else rng.choice(["@", " @ ", " (at) ", "(at)", "[at]", " [at] ", "{at}"] if dotted != "." else [" @ ", " (at) ", "(at)", "[at]", " [at] ", "{at}"])
        parts = [_name(rng) + (_digits(rng, int(rng.integers(0, 3))) if rng.random() < 0.3 else "") for _ in range(1 + int(rng.random() < 0.4))]
        local = (dotted if dotted != "." and rng.random() < 0.3 else rng.choice([".", "_", "-", ""])).join(parts)
        hosts = [_name(rng) + rng.choice(["", "-" + _name(rng)], p=[0.8, 0.2]) for _ in range(1 + int(rng.random() < 0.3))]
        text = local + at + dotted.join([*hosts, rng.choice(["com", "org", "net", "de", "fr", "es", "io", "co", "info", "edu"])])
        return text.upper() if rng.random() < 0.06 else text
    if kind == 1:
        return rng.choice([".", ".", "[.]", " . ", "(.)", ". ", "[dot]"]).join(str(p) for p in rng.integers(0, 256, 4))
    if kind == 2:
        return _card(rng)
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    forms = [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{_digits(rng, 2)} {_digits(rng, 3)} {_digits(rng, 7)}", f"00{rng.integers(1, 99)} {_digits(rng, 3)} {_digits(rng, 7)}", f"+{_digits(rng, 1)}-{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{_digits(rng, 2)}/{_digits(rng, 3)}/{b} {c}", f"0{_digits(rng, 3)}/{_digits(rng, 7)}", f"({a}){b}-{c}", f"+{_digits(rng, 2)} (0){_digits(rng, 2)} {c} {c}"]
    return rng.choice(forms)


def _plain(rng) -> str:
    """Text that looks like personal data and isn't."""
    forms = [
        f'"{"".join(rng.choice(list("0123456789abcdef"), int(rng.integers(8, 41))))}"', "".join(rng.choice(list("0123456789abcdefABCDEFghXYZ_-+/"), int(rng.integers(12, 48)))), _digits(rng, int(rng.integers(1, 9))), f"{rng.integers(0, 9)}.{rng.integers(0, 20)}",
        f"{rng.integers(0, 9)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}", f"{rng.integers(1, 999)},{_digits(rng, 3)}", f"{rng.integers(1, 29)}/{rng.integers(1, 13)}/{rng.integers(1900, 2030)}",
        f"{rng.integers(1900, 2030)}-{_digits(rng, 2)}-{_digits(rng, 2)}", f"Version {rng.integers(1, 9)}.0.", f"no. {_digits(rng, 5)}", f"@{_word(rng)}", f"{rng.integers(0, 24)}:{_digits(rng, 2)}", f"{rng.integers(1, 99)}%", f"+{rng.integers(1, 99)}", f"0x{_digits(rng, 8)}", f"${_digits(rng, 3)}.{_digits(rng, 2)}",
        f"{_word(rng)} at {_word(rng)}.", f"({_word(rng)}) {_word(rng)}", f"dot {_word(rng)}", f"{_word(rng)}.{_word(rng)}", f"https://{_name(rng)}.{_name(rng)}.com/{_name(rng)}/{_digits(rng, 3)}", f"{_word(rng)}_{_word(rng)}=", f"[{_digits(rng, 2)}]", f"{_digits(rng, 2)} | {_digits(rng, 3)} | {_digits(rng, 1)}", f"{_digits(rng, 4)}-{_digits(rng, 4)}",
        f"{_word(rng)}{rng.choice(['###', '&&&', '%%%', '***', '$$$', '!!', '...', ' -- ', ' | '])}",
    ]
    return rng.choice(forms)


def labelled(n: int, seed: int) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """n texts and their (start, kind, end). A third are ordinary words alone."""
    rng = _Random(seed)
    texts, spans = [], []
    for _ in range(n):
        text, own, share = "", [], rng.choice([0.0, 0.16, 0.26])
        style = rng.choice(["", "upper", "mixed"], p=[0.8, 0.06, 0.14])
        while len(text) < LEARN:
            p = rng.random()
            if p < share:
                k = rng.integers(0, len(KINDS))
                e = _entity(rng, k)
                own.append((len(text), k, len(text) + len(e)))
                text += e
            elif p < share + 0.12:
                text += _plain(rng)
            else:
                w = _word(rng) + (_word(rng) if rng.random() < 0.4 else "")
                text += w.upper() if style == "upper" else w.title() if rng.random() < 0.12 else w
            text += rng.choice([" ", " ", " ", " ", ", ", ". ", ".\n", "!! " if style else " ", " | " if style == "mixed" else " ", "; "])
        texts.append(text)
        spans.append(own)
    return texts, spans


def windows_of(texts: list[str], spans: list) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of the first LEARN characters of each text, as columns. A span that is cut keeps its part."""
    x, y = np.zeros((LEARN, len(texts)), np.int64), np.zeros((LEARN, len(texts)), np.int64)
    for j, (text, own) in enumerate(zip(texts, spans)):
        c = codes(text[:LEARN])
        x[: len(c), j] = c
        for s, k, e in own:
            if s < LEARN:
                y[s : min(e, LEARN), j] = 2 + 2 * k
                y[s, j] = 1 + 2 * k
    return x, y


@lru_cache(maxsize=1)
def trained() -> Tagger:
    """The model, trained on the driver from fixed seeds in about a minute: the same whatever data it is used on."""
    tagger = Tagger()
    tagger.train(*windows_of(*labelled(16_000, 3)), epochs=3, rate=0.02)
    return tagger


VALID = (
    lambda s: bool(re.search(r"[^\W_] ?(?:@|[\[({] ?at ?[\])}]) ?[A-Za-z0-9-]+ ?(?:\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9]", s, re.I)),
    lambda s: len(p := re.findall(r"[0-9]+", s)) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in p) and not re.search(r"[A-Za-z]", re.sub("dot", "", s)),
    lambda s: is_card(s) and not re.search(r"[^0-9 ./-]", s),
    lambda s: is_phone(s) and bool(re.search(r"[\x20().-]", s)) and not re.search(r"[^0-9 ().+/-]", s),
)


def add_spans(tagger: Tagger, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """What the model finds in each text besides `base`, by start: tagged() spans that touch no base span.

    Blanks and marks at a span's ends are left off. A span counts if it begins and ends with whole words and passes its kind's own check.
    """
    out = []
    for text, own, more in zip(texts, base, tagged(tagger, texts)):
        added = []
        for s, k, e in more:
            while s < e and text[s] in " .,;:!|\n\"'<":
                s += 1
            while e > s and text[e - 1] in " .,;:!|\n\"'>":
                e -= 1
            touches = text[s - 1 : s].isalnum() or text[e : e + 1].isalnum() or (k and (text[s - 1 : s] in ("#", "x", "-", ".", "+") or re.match(r"[-.][0-9]", text[e : e + 2])))
            if s < e and not touches and VALID[k](text[s:e]) and all(e <= a or s >= b for a, _, b in own):
                added.append((s, k, e))
        out.append(added)
    return out


def detect(texts: list[str | None], tagger: Tagger) -> tuple[list, list]:
    """Base spans and added spans of each text; some SLICE characters are held at once."""
    base, added, part, size = [], [], [], 0
    for k, t in enumerate(texts):
        part.append(t or "")
        size += len(part[-1])
        if size >= SLICE or k == len(texts) - 1:
            own = [base_spans(x) for x in part]
            base += own
            added += add_spans(tagger, part, own)
            part, size = [], 0
    return base, added


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row of `docs`.

    n_* count the base spans by kind and base_sha256 is the digest of their list; spans lists base spans and
    those that the model adds, n_added of them. Offsets are code points, ends exclusive. Null is the empty text.
    Repeated rows appear again; a null doc_id like others; an empty table gives no rows; other columns are ignored.
    """
    tagger = trained()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            base, added = detect(list(batch["text"]), tagger)
            out = {f"n_{name}": [sum(k == i for _, k, _ in b) for b in base] for i, name in enumerate(KINDS)}
            out |= {"base_sha256": [hashlib.sha256(listed(b).encode()).hexdigest() for b in base], "spans": [listed(sorted(b + a)) for b, a in zip(base, added)], "n_added": [len(a) for a in added]}
            yield pd.DataFrame({"id": batch["id"], **out})

    own = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    found = own.mapInPandas(each, "id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    return found.withColumn("doc_id", F.col("id").cast("long")).select("doc_id", *found.columns[1:])


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs`, all columns, each span of the text replaced by its kind in angle brackets. Null texts stay null."""
    tagger = trained()

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            base, added = detect(list(texts), tagger)
            out = []
            for text, b, a in zip(texts, base, added):
                at, parts = 0, []
                for s, k, e in sorted(b + a):
                    if e > at:  # base spans of different kinds may overlap
                        parts += [text[at:s], f"<{KINDS[k].upper()}>"] if s >= at else []
                        at = e
                out.append(text if not parts else "".join(parts) + text[at:])
            yield pd.Series(out, dtype=object)

    each.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(text_col, F.pandas_udf("string")(each)(F.col(text_col)))
