"""Audio kernels on PCM arrays: levels, fades, joins, slot fitting, stress from energy.

Kernels are plain numpy functions over arrays of samples by time, (n,) or (n, channels),
so tests need no session; :func:`over_clips` runs one over a DataFrame in Arrow batches.
"""

from __future__ import annotations

import io
import math
import wave
from typing import Callable

import numpy as np
from pyspark.sql import DataFrame

from .stress import MARK, VOWELS, WORD

# Fixed values of the kernels.
WINDOW_S = 0.05
SPEECH_FLOOR = 0.1
SILENT = 1 / 32_768
CEILING = 32_000 / 32_768
PEAK_ALLOWANCE = 1.6
KNEE = 0.7
MAX_GAIN = 4.0
GAIN_TOLERANCE = 1.035


def mono(x) -> np.ndarray:
    x = np.asarray(x, np.float32)
    if x.ndim not in (1, 2):
        raise ValueError(f"audio of {x.ndim} dimensions")
    return x if x.ndim == 1 else x.mean(axis=1).astype(np.float32)


def like(original, x: np.ndarray) -> np.ndarray:
    """Mono results in the channels of the original."""
    channels = np.ndim(original) == 2 and np.shape(original)[1]
    return np.repeat(x[:, None], channels, axis=1).astype(np.float32) if channels else x.astype(np.float32)


def hop(rate: int, seconds: float = WINDOW_S) -> int:
    return max(1, int(rate * seconds))


def windows(x: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Energy and sample count of every window; the last may be short."""
    at = np.arange(0, len(x), step)
    energy = np.add.reduceat(x.astype(np.float64) ** 2, at) if len(at) else np.zeros(0)
    return energy, np.diff([*at, len(x)])


def window_rms(x, rate: int) -> tuple[np.ndarray, np.ndarray]:
    energy, n = windows(mono(x), hop(rate)) if rate > 0 else windows(np.zeros(0, np.float32), 1)
    return np.sqrt(energy / np.maximum(n, 1)), n


def peak(x) -> float:
    return float(np.abs(x).max()) if np.size(x) else 0.0


def speech_rms(x, rate: int) -> float:
    """RMS over windows of at least a tenth of the loudest one, so pauses do not count."""
    r, n = window_rms(x, rate)
    if not len(r) or r.max() < SILENT:
        return 0.0
    on = r >= r.max() * SPEECH_FLOOR
    return float(np.sqrt((r[on] ** 2 * n[on]).sum() / n[on].sum()))


def active_seconds(x, rate: int) -> float:
    r, n = window_rms(x, rate)
    return float(n[r >= r.max() * SPEECH_FLOOR].sum() / rate) if len(r) and r.max() >= SILENT else 0.0


def volume(x) -> tuple[float | None, float | None]:
    """Mean and peak level in dB; null for silence."""
    p = peak(x)
    return (None, None) if p <= 0 else (20 * math.log10(float(np.sqrt(np.mean(np.square(x, dtype=np.float64))))), 20 * math.log10(p))


def soft_ceiling(x, gain: float, ceiling: float) -> np.ndarray:
    """Linear up to the knee, then tanh towards the ceiling."""
    y = np.asarray(x, np.float32) * gain
    top = min(1.0, max(SILENT, ceiling))
    knee, span = top * KNEE, top * (1 - KNEE)
    over = np.maximum(np.abs(y) - knee, 0)
    return np.where(over > 0, np.sign(y) * (knee + span * np.tanh(over / span)), y).astype(np.float32)


def match_level(x, rate: int, target_rms: float, ceiling: float) -> np.ndarray:
    """Two passes of bounded gain towards a speech level."""
    y = np.asarray(x, np.float32)
    for k in range(2):
        now = speech_rms(y, rate)
        if now < SILENT or (k and target_rms / now < GAIN_TOLERANCE):
            return y
        y = soft_ceiling(y, min(MAX_GAIN, target_rms / now), ceiling)
    return y


def limit_peak(x, reference) -> np.ndarray:
    p = peak(reference)
    return soft_ceiling(x, 1.0, CEILING if p < SILENT else min(CEILING, p * PEAK_ALLOWANCE))


def match_peak(x, target: float) -> np.ndarray:
    now, target = peak(x), min(1.0, max(0.0, target))
    if now < SILENT or target < SILENT or abs(target / now - 1) < 0.001:
        return x
    return np.clip(np.asarray(x, np.float32) * (target / now), -1, 1)


def fit_level(x, rate: int, reference, reference_rate: int) -> np.ndarray:
    level, p = speech_rms(reference, reference_rate), peak(reference)
    if level >= SILENT:
        return match_level(x, rate, level, min(CEILING, p * PEAK_ALLOWANCE))
    return match_peak(x, p) if p > 0 else x


def undo_fade(x, rate: int) -> np.ndarray:
    """Boost a clip that grows quieter: a line is fitted through log levels of its speech.

    Only slopes of at most -0.2 dB a second are undone; pauses, short clips and clips of
    little speech stay.
    """
    y = np.asarray(x, np.float32)
    if rate <= 0 or len(y) < int(rate * 1.5):
        return x
    step = hop(rate)
    r, _ = window_rms(y, rate)
    top = r.max()
    if top < 1e-6:
        return x
    speech = r >= top * 0.08
    edge = max(1, int(0.2 / WINDOW_S))
    if len(r) > 2 * edge:
        speech[:edge] = speech[-edge:] = False
    if speech.sum() < 8:
        return x
    t = (np.arange(len(r)) + 0.5) * step / rate
    slope = np.polyfit(t[speech], np.log(np.maximum(r[speech], 1e-8)), 1)[0] * 20 / math.log(10)
    if slope > -0.2:
        return x
    starts = np.minimum(len(y) - 1, np.arange(len(r)) * step) / rate
    gain = 10 ** (np.clip(-slope * (starts - t[speech][0]), 0, 20 * math.log10(MAX_GAIN)) / 20)
    gain = np.where(r >= top * 0.02, gain, 1.0)
    gain = np.convolve(np.pad(gain, 2, mode="edge"), np.ones(5) / 5, mode="valid")
    g = np.repeat(gain, step)[: len(y)].astype(np.float32)
    out = y * (g if y.ndim == 1 else g[:, None])
    return out * (0.99 / p) if (p := peak(out)) > 0.99 else out


def join(pieces: list, rate: int, fade_s: float = 0.04) -> np.ndarray:
    """Concatenate with crossfades of equal power."""
    if not pieces:
        raise ValueError("nothing to join")
    out = np.asarray(pieces[0], np.float32)
    for p in pieces[1:]:
        p = np.asarray(p, np.float32)
        n = min(max(1, int(rate * fade_s)), len(out), len(p))
        ramp = np.sqrt(np.linspace(0, 1, n, dtype=np.float32)).reshape(-1, *[1] * (p.ndim - 1))
        out = np.concatenate([out[: len(out) - n], out[len(out) - n :] * ramp[::-1] + p[:n] * ramp, p[n:]])
    return out


def pauses(x: np.ndarray, rate: int, least_s: float) -> list[tuple[int, int]]:
    """Runs of quiet windows within the clip, in samples; those at its ends do not count."""
    r, _ = window_rms(x, rate)
    if not len(r) or r.max() < SILENT:
        return []
    quiet = r < r.max() * SPEECH_FLOOR
    edges = np.flatnonzero(np.diff(np.concatenate([[False], quiet, [False]]).astype(int)))
    step = hop(rate)
    runs = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if a > 0 and b < len(r)]
    return [(int(a) * step, int(b) * step) for a, b in runs if (b - a) * step >= int(rate * least_s)]


def trim(x: np.ndarray, rate: int) -> np.ndarray:
    """Cut silent ends; a quiet last syllable counts as speech."""
    r, n = window_rms(x, rate)
    if not len(r) or r.max() < SILENT:
        return x
    step = hop(rate)
    first, last = np.flatnonzero(r >= r.max() * SPEECH_FLOOR)[0], np.flatnonzero(r >= r.max() * 0.05)[-1]
    a, b = max(0, int(first) * step - int(rate * 0.05)), min(len(x), int(last) * step + int(n[last]) + int(rate * 0.15))
    return x if b - a < int(rate * 0.8) else x[a:b]


def pad(x: np.ndarray, n: int) -> np.ndarray:
    """Silence up to n samples, 30 % of it in front."""
    extra = max(0, n - len(x))
    front = int(extra * 0.3)
    return np.pad(x, (front, extra - front))


def stretch(x, rate: float) -> np.ndarray:
    """Overlap-add in time, pitch kept; a rate above 1 is faster. Peaks stay under the input's."""
    x = np.asarray(x, np.float64)
    n = max(1, int(round(len(x) / rate)))
    frame = min(1024, max(64, len(x) // 4 * 2 or 64))
    frame += frame % 2
    if len(x) < frame:
        return np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x).astype(np.float32)
    step_out = max(1, frame // 4)
    step_in = max(1, int(round(step_out * rate)))
    w = np.hanning(frame)
    y, total = np.zeros(n + frame), np.zeros(n + frame)
    for k in range(min((len(x) - frame) // step_in, n // step_out) + 1):
        y[k * step_out : k * step_out + frame] += x[k * step_in : k * step_in + frame] * w
        total[k * step_out : k * step_out + frame] += w
    y = np.divide(y, total, out=y, where=total > 1e-8)[:n]
    return (y * (peak(x) / peak(y)) if peak(y) > peak(x) > SILENT else y).astype(np.float32)


def share_out(n: int, weights: list[int]) -> list[int]:
    """n in whole parts by weight; what rounding leaves goes to the last."""
    out, left, rest = [], n, sum(weights)
    for k, w in enumerate(weights):
        take = left if k == len(weights) - 1 else max(0, min(left, int(round(left * w / rest)) if rest else 0))
        out.append(take)
        left, rest = left - take, rest - w
    return out


def _widen(x: np.ndarray, rate: int, n: int) -> np.ndarray:
    """Longer pauses, up to 0.4 s each, in proportion to their lengths."""
    found = pauses(x, rate, 0.15)
    room = [max(0, int(rate * 0.4) - (b - a)) for a, b in found]
    extra = min(n - len(x), sum(room))
    if extra <= 0:
        return pad(x, n)
    lengths = [b - a for a, b in found]
    add = [min(r, int(extra * w / sum(lengths))) for r, w in zip(room, lengths)]
    for k, r in enumerate(room):
        add[k] += min(r - add[k], extra - sum(add))
    out, at = [], 0
    for (a, b), k in zip(found, add):
        out += [x[at : (a + b) // 2], np.zeros(k, x.dtype)]
        at = (a + b) // 2
    return np.concatenate([*out, x[at:]])


def _hasten(x: np.ndarray, rate: int, n: int, cap: float) -> np.ndarray:
    """Faster speech between the pauses: all of it is stretched as one piece, then cut up again."""
    cuts = [0, *(p for pause in pauses(x, rate, 0.10) for p in pause), len(x)]
    parts = [x[a:b] for a, b in zip(cuts, cuts[1:])]
    speech = [p for p in parts[::2] if len(p)]
    spoken, silent = sum(map(len, speech)), sum(map(len, parts[1::2]))
    if not spoken or n <= silent:
        return x
    by = min(max(min(spoken / (n - silent), cap), 1.0), 1.18)
    if by <= 1.02:
        return x
    fast = stretch(np.concatenate(speech), by)
    pieces = iter(np.split(fast, np.cumsum(share_out(len(fast), [len(p) for p in speech]))[:-1]))
    return np.concatenate([(next(pieces) if len(p) else p) if k % 2 == 0 else p for k, p in enumerate(parts)])


def fit_slot(x, rate: int, reference, reference_rate: int, syllables: int, reference_syllables: int) -> np.ndarray:
    """Fit a clip to the length of a reference: trim, then longer pauses, or faster speech.

    Speech is not hastened beyond 1.15 times the reference's syllables a second, where both
    rates are plausible. Short lines stay as they are.
    """
    y, line = mono(x), mono(reference)
    if rate <= 0 or reference_rate <= 0 or len(y) < 0.8 * rate or len(line) < 1.2 * reference_rate or min(syllables, reference_syllables) < 4:
        return x
    y, slot = trim(y, rate), len(line) / reference_rate
    spoken, acted = active_seconds(y, rate), active_seconds(line, reference_rate)
    if spoken <= 0 or acted <= 0:
        return like(x, y)
    n, length = int(round(slot * rate)), len(y) / rate
    if abs(length - slot) > max(0.05 * slot, 0.35):
        if length < slot:
            y = _widen(y, rate, n)
            y = pad(y, n) if len(y) < n * 0.95 else y
        else:
            own, actor = syllables / spoken, reference_syllables / acted
            plausible = all(1.2 <= v <= 8.0 for v in (own, actor))
            y = _hasten(y, rate, n, 1.15 * actor / own if plausible else math.inf)
    return like(x, limit_peak(y, line))


# Fixed values of the remaster: crossovers in Hz and, of each band, its weight beside the body
# of the voice, how far quiet parts rise, and the most they rise in dB.
CROSSOVERS = (250.0, 800.0, 2500.0, 6000.0)
BAND_WEIGHTS = (0.80, 1.00, 0.75, 0.32, 0.08)
BAND_RISE = (2.5, 2.5, 2.2, 1.4, 1.2)
BAND_MOST_DB = (10.0, 10.0, 8.0, 3.0, 1.5)
STEP_S = 0.004
LOUD, FAINT = 0.12, 0.03  # of the loudest window: speech, and what can still be its ending
DRIVE = 10 ** (-16 / 20)
LIMIT = 10 ** (-0.3 / 20)


def decibels(x: float) -> float:
    """A factor from dB."""
    return 10 ** (x / 20)


def shaped(x: np.ndarray, rate: int, gain: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The signal with a gain by frequency."""
    f = np.fft.rfftfreq(len(x), 1 / rate)
    return np.fft.irfft(np.fft.rfft(x) * gain(f), len(x)).astype(np.float32)


def below(f: np.ndarray, hz: float) -> np.ndarray:
    """The weight of frequencies under a cut, of fourth order; above it the rest of 1."""
    return 1 / (1 + (f / hz) ** 4)


def highpass(x: np.ndarray, rate: int, hz: float = 80.0) -> np.ndarray:
    return shaped(x, rate, lambda f: 1 - below(f, hz))


def between(x: np.ndarray, rate: int, low: float, high: float) -> np.ndarray:
    return shaped(x, rate, lambda f: (1 - below(f, low)) * below(f, high))


def bands(x: np.ndarray, rate: int, edges: tuple[float, ...] = CROSSOVERS) -> list[np.ndarray]:
    """Bands between the edges that add up to the input: what a higher cut lets through beyond the lower one."""
    spectrum, f = np.fft.rfft(x), np.fft.rfftfreq(len(x), 1 / rate)
    upto = np.maximum.accumulate([np.zeros(len(f)), *(below(f, e) for e in edges), np.ones(len(f))], axis=0)
    return [np.fft.irfft(spectrum * w, len(x)).astype(np.float32) for w in np.diff(upto, axis=0)]


def envelope(x: np.ndarray, rate: int) -> np.ndarray:
    energy, n = windows(x, hop(rate, STEP_S))
    return np.sqrt(energy / np.maximum(n, 1))


def glide(goal: np.ndarray, attack_s: float, release_s: float) -> np.ndarray:
    """A gain by window that moves towards its goal, down at one pace and up at another."""
    keep = [math.exp(-STEP_S / t) for t in (attack_s, release_s)]
    out, now = np.empty(len(goal)), float(goal[0]) if len(goal) else 1.0
    for k, g in enumerate(goal.tolist()):
        now = g + keep[g >= now] * (now - g)
        out[k] = now
    return out


def applied(x: np.ndarray, rate: int, gain: np.ndarray) -> np.ndarray:
    """The signal times a gain by window, in lines between the windows' middles."""
    step = hop(rate, STEP_S)
    return (x * np.interp(np.arange(len(x)), (np.arange(len(gain)) + 0.5) * step, gain)).astype(np.float32)


def squeezed(x: np.ndarray, rate: int, line: float, floor: float, fall: float, rise: float, most: float, attack_s: float, release_s: float) -> np.ndarray:
    """Levels above the line fall towards it, those under it rise; what is under the floor stays."""
    e = envelope(x, rate)
    far = np.maximum(e, 1e-12) / line
    power = np.where(e > line, 1 / fall, np.where(e >= floor, 1 / rise, 1.0)) - 1
    return applied(x, rate, glide(np.clip(far**power, decibels(-12), most), attack_s, release_s))


def spoken(e: np.ndarray) -> np.ndarray:
    """Of an envelope, the windows that are speech: loud ones, faint dips within a word, a faint ending."""
    loud, faint = e >= e.max() * LOUD, e >= e.max() * FAINT
    runs = np.flatnonzero(np.diff(np.concatenate([[0], loud.astype(np.int8), [0]]))).reshape(-1, 2)
    on, sizes = loud.copy(), runs[:, 1] - runs[:, 0]
    dips = runs[1:, 0] - runs[:-1, 1]
    for k in np.flatnonzero(dips < np.minimum(np.minimum(sizes[1:], sizes[:-1]), 0.2 * np.median(sizes))):
        on[runs[k, 1] : runs[k + 1, 0]] = faint[runs[k, 1] : runs[k + 1, 0]]  # much shorter than a word
    on[runs[-1, 1] :] = faint[runs[-1, 1] :]
    return on


def fine_rms(x: np.ndarray, rate: int) -> float:
    """RMS over short windows of at least a tenth of the loudest one."""
    e = envelope(x, rate)
    on = e >= e.max() * SPEECH_FLOOR
    return float(np.sqrt(np.mean(e[on] ** 2))) if e.max() >= SILENT else 0.0


def even_speech(x: np.ndarray, rate: int) -> np.ndarray:
    """All speech at one level; pauses and silence stay."""
    e = envelope(x, rate)
    if e.max() < SILENT:
        return x
    goal = np.where(spoken(e), np.clip(fine_rms(x, rate) / np.maximum(e, SILENT), decibels(-12), decibels(18)), 1.0)
    return applied(x, rate, glide(goal, 0.001, 0.008))


def without_hiss(x: np.ndarray, rate: int, floor: float) -> np.ndarray:
    """Sibilants, 6 to 9 kHz, give way where they outrun 2 to 4 kHz."""
    hiss = between(x, rate, 6000, 9000)
    e, beside = envelope(hiss, rate), envelope(between(x, rate, 2000, 4000), rate)
    ratio = e / np.maximum(beside, max(floor, SILENT))
    gain = glide(np.where((e > floor) & (ratio > 1.4), 1 / np.minimum(ratio, 4), 1.0), 0.004, 0.04)
    return x - hiss + applied(hiss, rate, gain)


def limit_ahead(x: np.ndarray, rate: int, ceiling: float = LIMIT, ahead_s: float = 0.003) -> np.ndarray:
    """No sample above the ceiling: gain falls before a peak and rises slowly after it."""
    step = hop(rate, STEP_S)
    n = -(-len(x) // step)
    tops = np.abs(np.pad(x, (0, n * step - len(x)))).reshape(n, step).max(axis=1)
    reach = max(1, -(-int(rate * ahead_s) // step))
    wide = np.lib.stride_tricks.sliding_window_view(np.pad(tops, (1, reach + 1)), reach + 3).max(axis=1)[:n]
    y = applied(x, rate, glide(np.minimum(1.0, ceiling / np.maximum(wide, SILENT)), 0.001, 0.05))
    return np.clip(y, -ceiling, ceiling)


def end_fade(x: np.ndarray, rate: int) -> np.ndarray:
    """A quiet end fades out over 20 ms; a loud one is kept but for 8 ms against a click."""
    n = max(1, int(rate * 0.02))
    if len(x) <= n:
        return x
    m = n if peak(x[-n:]) < peak(x) * LOUD else max(1, int(rate * 0.008))
    return np.concatenate([x[:-m], x[-m:] * np.linspace(1, 0, m, dtype=np.float32)])


def remaster(x, rate: int) -> np.ndarray:
    """A light remaster of speech: high-pass, bands towards usual weights and squeezed, presence, sibilants,
    one level for all speech, drive, limit, end fade. The length stays."""
    y = mono(x)
    if rate <= 0 or len(y) < int(rate * 0.08) or peak(y) < SILENT:
        return x
    y = highpass(y, rate)
    parts, floor = bands(y, rate), envelope(y, rate).max() * 0.05
    body = fine_rms(parts[1], rate) or fine_rms(y, rate)
    if body < SILENT:
        return x
    out = np.zeros_like(y)
    for k, p in enumerate(parts):
        now, high = fine_rms(p, rate), k >= 3
        if now >= SILENT:
            own = body * BAND_WEIGHTS[k]
            p = p * np.float32(np.clip(own / now, decibels(-12), decibels(15)))
            out += squeezed(p, rate, max(floor * 1.5, own * LOUD), floor * (3 if high else 1), 4.0, BAND_RISE[k], decibels(BAND_MOST_DB[k]), 0.008 if high else 0.005, 0.08 if high else 0.06)
    bell = lambda f, hz, db, q: db * np.exp(-0.5 * (np.log(np.maximum(f, 1) / hz) * q) ** 2)
    out = shaped(out, rate, lambda f: 10 ** ((bell(f, 3200, 3.5, 1.1) + bell(f, 7500, 1.0, 0.8)) / 20))
    out = without_hiss(out, rate, floor)
    out = squeezed(out, rate, max(floor * 2, DRIVE * LOUD), floor, 3.0, 1.8, decibels(4), 0.012, 0.1)
    out = even_speech(out, rate)
    now = fine_rms(out, rate)
    if now >= SILENT:
        out = out * np.float32(min(decibels(8), DRIVE / now))
    return like(x, end_fade(limit_ahead(out, rate), rate))


def finish(x, rate: int, reference, reference_rate: int, syllables: int = 0, reference_syllables: int = 0, loudness: bool = True, timing: bool = True) -> np.ndarray:
    """Loudness first, timing second, each if asked for."""
    if loudness:
        x = fit_level(remaster(undo_fade(x, rate), rate), rate, reference, reference_rate)
    return fit_slot(x, rate, reference, reference_rate, syllables, reference_syllables) if timing else x


#: Words too weak to be marked by their sound (pronouns, particles, prepositions).
WEAK = frozenset(
    """
    не на що він до це як за так її ви про ти та був ще від чи ми все йому коли нього із тут вже то щоб там по
    того ні для те була їх той вам вас щось але або бо же би б і й у в з зі під над при без через після перед між
    коло біля ось ну хай нехай аби хоч хоча якщо тоді тепер потім тому цього цю ця цей ці цих цим свої свій своя
    своє мене мені мною тебе тобі тобою нас нам нами них ним ними нею неї його вона воно вони я а де куди звідки
    чому хто кого кому ким чим чого собі себе собою було були є буде може можна треба має ньому вами отож також
    """.split()
)


def stressed_vowel(word: str, x: np.ndarray) -> int | None:
    """The place of the vowel that sounds clearly loudest; None if unsure."""
    at = [k for k, c in enumerate(word) if c in VOWELS]
    if len(at) < 2 or len(x) < 8:
        return None
    cuts = [int(k * len(x) / len(at)) for k in range(len(at))] + [len(x)]
    level = np.array([float(np.sqrt(np.mean(np.square(x[a:b])))) if b > a else 0.0 for a, b in zip(cuts, cuts[1:])])
    level[[0, -1]] *= 0.92  # ends of words are loud without being stressed
    best, second = np.argsort(-level, kind="stable")[:2]
    return at[best] if level[best] > 0 and level[best] >= 1.15 * level[second] else None


def mark_by_sound(text: str, x, rate: int, spans: list[tuple[float, float]] | None = None) -> str:
    """Stress marks for words of two vowels and more, from the energy of their sound."""
    x, found = mono(x), list(WORD.finditer(text))
    if not found or not len(x) or rate <= 0:
        return text
    weights = [max(1, sum(c in VOWELS for c in m[0])) for m in found]
    ends = np.cumsum(weights) / sum(weights) * len(x) / rate
    times = spans if spans and len(spans) == len(found) else list(zip([0.0, *ends[:-1]], ends))
    out, at = [], 0
    for m, (a, b) in zip(found, times):
        word = m[0]
        ok = MARK not in word and word.casefold() not in WEAK and b - a >= 0.08
        k = stressed_vowel(word, x[max(0, int(a * rate)) : int(b * rate)]) if ok else None
        out += [text[at : m.start()], word if k is None else word[: k + 1] + MARK + word[k + 1 :]]
        at = m.end()
    return "".join([*out, text[at:]])


def wav_header(content: bytes | None) -> tuple[float | None, int | None]:
    """Seconds and sample rate of a WAV file's bytes; nulls if it cannot be read."""
    try:
        with wave.open(io.BytesIO(content or b"")) as w:
            return w.getnframes() / w.getframerate(), w.getframerate()
    except (wave.Error, EOFError, ZeroDivisionError):
        return None, None


#: Fixed values of WAV files: tags of a format chunk.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def _chunks(content: bytes) -> dict[bytes, bytes]:
    """The first chunk of each name; a data chunk may end with the file."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    found: dict[bytes, bytes] = {}
    at = 12
    while at + 8 <= len(content):
        name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
        found.setdefault(name, content[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return found


def wav_samples(content: bytes) -> tuple[np.ndarray, int]:
    """Samples in -1 to 1, downmixed, of PCM of 8, 16, 24 or 32 bits and of 32- or 64-bit floats."""
    parts = _chunks(content)
    if b"fmt " not in parts or b"data" not in parts:
        raise ValueError("a WAV file without format or data")
    about, data = parts[b"fmt "], parts[b"data"]
    number = lambda at, n: int.from_bytes(about[at : at + n], "little")
    kind, channels, rate, bits = number(0, 2), number(2, 2), number(4, 4), number(14, 2)
    kind = number(24, 2) if kind == EXTENSIBLE and len(about) >= 26 else kind
    if channels < 1 or (kind, bits) not in ((PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)):
        raise ValueError(f"WAV format {kind} of {bits} bits in {channels} channels")
    raw = np.frombuffer(data, np.uint8)[: len(data) // (channels * bits // 8) * (channels * bits // 8)]
    if kind == FLOAT:
        x = raw.view(f"<f{bits // 8}").astype(np.float32)
    elif bits == 8:  # the only width without a sign
        x = (raw.astype(np.float32) - 128) / 128
    elif bits == 24:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = raw.reshape(-1, 3)
        x = (wide.view("<i4")[:, 0] / 2.0**31).astype(np.float32)
    else:
        x = (raw.view(f"<i{bits // 8}") / 2.0 ** (bits - 1)).astype(np.float32)
    return x.reshape(-1, channels).mean(axis=1), rate


def cut_wav(content: bytes, start: float, end: float, padding: float = 0.05) -> bytes:
    """The WAV bytes of a padded span."""
    with wave.open(io.BytesIO(content)) as w:
        rate = w.getframerate()
        a, b = int(max(0.0, start - padding) * rate), int((end + padding) * rate)
        w.setpos(min(a, w.getnframes()))
        frames, params = w.readframes(max(0, b - a)), w.getparams()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams(params)
        w.writeframes(frames)
    return out.getvalue()


def over_clips(df: DataFrame, kernel: Callable[[np.ndarray, int], np.ndarray], samples: str = "samples", rate: str = "sample_rate") -> DataFrame:
    """Apply a kernel to the samples of every row, in Arrow batches."""

    def run(frames):
        for pdf in frames:
            pdf[samples] = [None if x is None else np.asarray(kernel(np.asarray(x, np.float32), int(r)), np.float32).tolist() for x, r in zip(pdf[samples], pdf[rate])]
            yield pdf

    return df.mapInPandas(run, df.schema)


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Another sample rate, by lines between samples."""
    if rate == to or not len(x):
        return x
    return np.interp(np.arange(int(round(len(x) * to / rate))) * rate / to, np.arange(len(x)), x).astype(np.float32)


def join_references(contents: list[bytes], rate: int = 44_100, most: int = 5) -> bytes:
    """One to five WAV files in order as one, mono, of one rate; a single file stays as it is."""
    if not 1 <= len(contents) <= most:
        raise ValueError(f"1 to {most} references, not {len(contents)}")
    if len(contents) == 1:
        return contents[0]
    x = np.concatenate([resample(*wav_samples(c), rate) for c in contents])
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32_767).astype("<i2").tobytes())
    return out.getvalue()
