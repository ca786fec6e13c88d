"""Signals: waveforms as arrays of samples, features as arrays of frames.

Arithmetic on samples is expressed in columns; transforms that need a Fourier transform or a recursion over frames are
numpy kernels in Arrow batches.  Encoders other than PCM WAV, and everything that needs a trained model (speech
recognition, codecs, speaker and quality models), are interfaces only: give their output as a column.

Defined results: null waveforms give null; empty ones give empty arrays, or null where a value is asked for; random
steps are repeatable by seed and key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as N

VECTOR, MATRIX = T.ArrayType(T.DoubleType()), T.ArrayType(T.ArrayType(T.DoubleType()))


# columns
def trimmed(wave: Column, rate: int, begin: float, end: float) -> Column:
    """Samples between two times."""
    a, b = int(begin * rate), int(end * rate)
    return F.slice(wave, a + 1, max(0, b - a))


def random_chunk(wave: Column, n: int, hop: int, key: Column, seed: int) -> Column:
    """n samples from a place that is a multiple of twice the hop; shorter waves whole."""
    steps = F.greatest(F.floor((F.size(wave) - n) / (2 * hop)) + 1, F.lit(1))
    at = F.pmod(F.xxhash64(key, F.lit(seed)), steps) * 2 * hop
    return F.when(F.size(wave) > n, F.slice(wave, (at + 1).cast("int"), n)).otherwise(wave)


def padded(wave: Column, left: int, right: int, value: float = 0.0) -> Column:
    fill = lambda k: F.array_repeat(F.lit(value), k)
    return F.concat(fill(left), wave.cast("array<double>"), fill(right))


def padded_to_multiple(wave: Column, m: int, value: float = 0.0) -> Column:
    return F.concat(wave.cast("array<double>"), F.array_repeat(F.lit(value), F.pmod(-F.size(wave), F.lit(m))))


def scaled(wave: Column, factor: Column | float) -> Column:
    """Volume, kept within -1 and 1."""
    f = factor if isinstance(factor, Column) else F.lit(factor)
    return F.transform(wave, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * f)))


def faded(wave: Column, left: int, right: int) -> Column:
    """Log-spaced fades over so many samples at the ends."""
    up, down = N.fade_curve(F.lit(left)), F.reverse(N.fade_curve(F.lit(right)))
    n = F.size(wave)
    return F.transform(wave, lambda x, i: x * F.when(i < left, F.get(up, i)).otherwise(1.0) * F.when(i >= n - right, F.get(down, i - n + right)).otherwise(1.0))


def preemphasis(wave: Column, beta: float = 0.97) -> Column:
    """x[i] - beta x[i-1]."""
    before = F.slice(F.concat(F.array(F.lit(0.0)), wave), 1, F.size(wave))
    return F.zip_with(wave, before, lambda x, y: x - beta * y)


def mu_law(wave: Column, bits: int = 16, quantize: bool = False) -> Column:
    """sign(x) ln(1 + mu |x|) / ln(1 + mu) for fewer than 16 bits; quantised to whole steps on demand."""
    mu = float(2**bits - 1)
    code = (lambda x: F.signum(x) * F.ln(1 + mu * F.abs(x)) / F.ln(F.lit(1 + mu))) if bits < 16 else (lambda x: x)
    if not quantize:
        return F.transform(wave, code)
    return F.transform(wave, lambda x: F.floor((code(x) + 1) / 2 * mu + 0.5).cast("bigint"))


def mu_law_inverse(code: Column, bits: int = 16, quantized: bool = False) -> Column:
    mu = float(2**bits - 1)
    y = (lambda c: c / mu * 2 - 1) if quantized else (lambda c: c)
    back = (lambda v: F.signum(v) * (F.pow(F.lit(1 + mu), F.abs(v)) - 1) / mu) if bits < 16 else (lambda v: v)
    return F.transform(code, lambda c: back(y(c.cast("double"))))


def split_codes(code: Column, bits: int) -> Column:
    """High and low half of quantised codes."""
    h = 2 ** (bits // 2)
    return F.struct(F.transform(code, lambda c: F.floor(c / h).cast("bigint")).alias("coarse"), F.transform(code, lambda c: F.pmod(c, F.lit(h))).alias("fine"))


def joined_codes(coarse: Column, fine: Column, bits: int) -> Column:
    return F.zip_with(coarse, fine, lambda a, b: a * (2 ** (bits // 2)) + b)


def to_int16(wave: Column) -> Column:
    return F.transform(wave, lambda x: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.round(x * 32767).cast("int"))))


def from_int16(wave: Column) -> Column:
    return F.transform(wave, lambda x: x / 32767.0)


def resampled(wave: Column, rate: int, to: int) -> Column:
    """Linear resampling (a documented simplification of band-limited resampling)."""
    return N.resample(wave, F.ceil(F.size(wave) * to / rate).cast("int"))


def rms(wave: Column) -> Column:
    return F.when(F.size(wave) > 0, N.norm(wave) / F.sqrt(F.size(wave)))


def gain_to(wave: Column, level: float) -> Column:
    """Scaled so that the RMS has the given level in dB of full scale; silence stays."""
    return scaled(wave, F.when(rms(wave) > 0, F.lit(10 ** (level / 20)) / rms(wave)).otherwise(F.lit(1.0)))


def mean_volume(frames: Column) -> Column:
    """Mean of the RMS of frames."""
    return N.array_mean(F.transform(frames, rms))


def amplitude_to_log(frame: Column, floor: float = 1e-5) -> Column:
    return F.transform(frame, lambda x: N.log_floor(x, floor))


def log_to_amplitude(frame: Column) -> Column:
    return F.transform(frame, F.exp)


def energy(frames: Column) -> Column:
    return F.transform(frames, N.norm)


def flatness(frame: Column, floor: float = 1e-10) -> Column:
    """Geometric over arithmetic mean of the power."""
    p = F.transform(frame, lambda x: F.greatest(x * x, F.lit(floor)))
    return F.exp(N.array_mean(F.transform(p, F.ln))) / N.array_mean(p)


def tilt(frame: Column) -> Column:
    """Slope of the least-squares line through the values of a frame."""
    n = F.size(frame)
    middle = (n - 1) / 2
    pairs = F.transform(frame, lambda x, i: (i - middle) * x)
    return F.when(n > 1, N.array_sum(pairs) / (n * (n * n - 1) / 12))


def normalized(values: Column, low: Column, high: Column) -> Column:
    return F.transform(values, lambda x: F.try_divide(x - low, high - low))


def near_mean(values: Column, m: float = 2.0) -> Column:
    """The values nearer to their mean than m population deviations."""

    def kept(mean: Column) -> Column:
        spread = F.sqrt(N.array_mean(F.transform(values, lambda x: (x - mean) * (x - mean))))
        return N.let(spread, lambda s: F.filter(values, lambda x: F.abs(x - mean) < m * s))

    return N.let(N.array_mean(values), kept)


def quantile(values: Column, q: float) -> Column:
    """Linearly interpolated quantile of an array; null if it is empty."""
    return F.when(F.size(values) > 0, N.lerp(F.array_sort(values), (F.size(values) - 1) * F.lit(q)))


def sample_normalized(values: Column, method: str = "minmax", q: float = 0.95, outliers: bool = True, low: float | None = None, high: float | None = None) -> Column:
    """Values normalised by their own sample: minmax, quantile (1 - q to q) or z-norm (mean and four deviations). outliers
    false: bounds, mean and deviation without the values far from the mean. low and high replace the bounds of minmax and
    quantile; for z-norm they bound the values that count. A sample that varies too little (bounds nearer than 1, mean
    or variance below 1) gives null."""

    def scaled_by(v: Column) -> Column:
        if method == "z-norm":
            some = v if low is None else F.filter(v, lambda x: x >= low)
            some = some if high is None else F.filter(some, lambda x: x <= high)
            mean = N.array_mean(some)
            var = N.let(mean, lambda m: N.array_mean(F.transform(some, lambda x: (x - m) * (x - m))))
            pair = F.struct(mean.alias("a"), (4 * F.sqrt(var)).alias("b"))
            return N.let(pair, lambda p: F.when((p["a"] >= 1) & (p["b"] >= 4), F.transform(values, lambda x: (x - p["a"]) / p["b"])))
        if method not in ("minmax", "quantile"):
            raise ValueError(f"no method {method}")
        a, b = (F.array_min(v), F.array_max(v)) if method == "minmax" else (quantile(v, 1 - q), quantile(v, q))
        new = lambda c, given: c if given is None else F.lit(given)
        pair = F.struct(a.alias("a"), b.alias("b"))
        return N.let(pair, lambda p: F.when(F.abs(p["b"] - p["a"]) >= 1, normalized(values, new(p["a"], low), new(p["b"], high))))

    return N.let(values if outliers else near_mean(values), scaled_by)


def mixed(wave: Column, noise: Column, snr: float) -> Column:
    """The wave with noise at a signal-to-noise ratio in dB; noise is repeated or cut to the length of the wave."""
    at = lambda i: F.get(noise, F.pmod(i, F.size(noise)))
    g = F.try_divide(rms(wave), rms(noise)) * 10 ** (-snr / 20)
    return F.when(F.size(noise) > 0, F.transform(wave, lambda x, i: x + at(i) * F.coalesce(g, F.lit(0.0)))).otherwise(wave)


def gated(p: float, seed: int, key: Column, yes: Column, no: Column) -> Column:
    """One of two columns by a repeatable chance of the key."""
    from .samplers import uniform

    return F.when(uniform(key, seed) < p, yes).otherwise(no)


# kernels
def kernel(f: Callable[..., object], kind: T.DataType):
    """A kernel on numpy arrays as a column function; null or empty input gives null."""

    @F.pandas_udf(kind)
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in parts:
            cols = cols if isinstance(cols, tuple) else (cols,)  # one argument comes alone
            out = []
            for row in zip(*cols):
                if any(v is None for v in row) or len(row[0]) == 0:
                    out.append(None)
                    continue
                first = np.array([np.asarray(x, float) for x in row[0]]) if isinstance(row[0][0], (list, np.ndarray)) else np.asarray(row[0], float)
                got = f(first, *row[1:])
                out.append(got.tolist() if isinstance(got, np.ndarray) else got)
            yield pd.Series(out)

    return run


def inverse_preemphasis_(x: np.ndarray, beta: float = 0.97) -> np.ndarray:
    out, last = np.empty_like(x), 0.0
    for i, v in enumerate(x):
        last = out[i] = v + beta * last
    return out


def framed(x: np.ndarray, size: int, hop: int, centred: bool = True) -> np.ndarray:
    """Frames of a wave; centred: half a frame is mirrored at the ends."""
    if centred:
        half = size // 2
        x = np.pad(x, half, mode="reflect" if len(x) > half else "edge")
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def stft(x: np.ndarray, size: int = 1024, hop: int = 256) -> np.ndarray:
    return np.fft.rfft(framed(x, size, hop) * hann(size), axis=1)


def magnitude_(x: np.ndarray, size: int = 1024, hop: int = 256) -> np.ndarray:
    return np.abs(stft(x, int(size), int(hop)))


def istft(s: np.ndarray, size: int, hop: int, length: int) -> np.ndarray:
    """Overlap-add with the squared window divided out."""
    w = hann(size)
    out, norm = np.zeros(size + hop * (len(s) - 1)), np.zeros(size + hop * (len(s) - 1))
    for i, frame in enumerate(np.fft.irfft(s, size, axis=1)):
        out[i * hop : i * hop + size] += frame * w
        norm[i * hop : i * hop + size] += w * w
    out /= np.maximum(norm, 1e-8)
    return out[size // 2 : size // 2 + length]


def mels(f: np.ndarray | float, htk: bool = False) -> np.ndarray:
    """Mel of a frequency. By default straight up to 1000 Hz, 15 mels, and logarithmic beyond, 27 mels for a factor 6.4
    (fixed values); htk: 2595 log10(1 + f / 700)."""
    f = np.asarray(f, float)
    return 2595 * np.log10(1 + f / 700) if htk else np.where(f < 1000, 3 * f / 200, 15 + 27 * np.log(np.maximum(f, 1000) / 1000) / np.log(6.4))


def hertz(m: np.ndarray, htk: bool = False) -> np.ndarray:
    """Frequency of a mel."""
    return 700 * (10 ** (m / 2595) - 1) if htk else np.where(m < 15, 200 * m / 3, 1000 * np.exp(np.log(6.4) * (m - 15) / 27))


def mel_basis(bins: int, rate: float, bands: int, low: float = 0.0, high: float | None = None, htk: bool = False) -> np.ndarray:
    """Triangular filters evenly spaced on the mel scale between two frequencies, area-normalised."""
    edges = hertz(np.linspace(mels(low, htk), mels(high or rate / 2, htk), bands + 2), htk)
    f = np.linspace(0, rate / 2, bins)
    up = (f - edges[:-2, None]) / np.maximum(edges[1:-1, None] - edges[:-2, None], 1e-9)
    down = (edges[2:, None] - f) / np.maximum(edges[2:, None] - edges[1:-1, None], 1e-9)
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mel_(s: np.ndarray, rate: float, bands: int, low: float = 0.0, high: float = 0.0, htk: bool = False) -> np.ndarray:
    """Bands of a magnitude spectrogram; high 0: half the rate."""
    return s @ mel_basis(s.shape[1], rate, int(bands), low, high, htk).T


def mel_inverse_(m: np.ndarray, rate: float, bins: int) -> np.ndarray:
    return np.maximum(0, m @ np.linalg.pinv(mel_basis(int(bins), rate, m.shape[1])).T)


def pitch_(x: np.ndarray, rate: float, size: int = 512, hop: int = 256, low: float = 100.0, high: float = 500.0, limit: float = 0.1) -> np.ndarray:
    """Fundamental frequency by the cumulative mean normalised difference over whole frames, in whole samples; 0 where it
    stays over the limit or the frame has no positive sample. Zeros stand before and after the wave."""
    size, hop = int(size), int(hop)
    x = np.pad(x, size // 2 + 1)
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[: max(0, len(x) - size) : hop]
    least, most = int(rate / high), min(int(rate / low), size)
    out = np.zeros(len(frames))
    if not len(frames) or most < 2:
        return out
    d = np.stack([((frames[:, : size - t] - frames[:, t:]) ** 2).sum(1) for t in range(most)], 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        norm = np.concatenate([np.ones((len(d), 1)), d[:, 1:] * np.arange(1, most) / np.cumsum(d[:, 1:], 1)], 1)
    clear = norm[:, least:] < limit
    rise = np.concatenate([norm[:, 1:] >= norm[:, :-1], np.ones((len(norm), 1), bool)], 1) | ~np.isfinite(norm)
    for i in np.flatnonzero(clear.any(1) & (frames.max(1) > 0)):
        first = least + int(clear[i].argmax())  # down to the next minimum
        t = first + int(rise[i, first:].argmax())
        out[i] = rate / t if t else 0.0
    return out


def levinson(r: np.ndarray, order: int) -> np.ndarray:
    """Prediction coefficients (1, a1, ...) from autocorrelations."""
    a, err = np.zeros(order + 1), float(r[0]) or 1e-12
    a[0] = 1.0
    for i in range(1, order + 1):
        k = -(r[i] + a[1:i] @ r[i - 1 : 0 : -1]) / err
        a[1 : i + 1] += k * np.append(a[i - 1 : 0 : -1], 1.0)
        err = max(err * (1 - k * k), 1e-12)
    return a


def lpc_(s: np.ndarray, order: int) -> np.ndarray:
    """Prediction coefficients of the frames of a magnitude spectrogram."""
    r = np.fft.irfft(s**2, axis=1)
    return np.stack([levinson(x, int(order)) for x in r])


def envelope_(s: np.ndarray, keep: int = 20) -> np.ndarray:
    """Smooth log spectrum: only the first cepstral coefficients are kept."""
    c = np.fft.irfft(np.log(np.maximum(s, 1e-5)), axis=1)
    n = c.shape[1]
    lifter = np.zeros(n)
    lifter[: int(keep)] = 1
    lifter[n - int(keep) + 1 :] = 1
    return np.fft.rfft(c * lifter, axis=1).real


def wavelet_(x: np.ndarray, scales: list) -> np.ndarray:
    """Convolutions with Mexican-hat wavelets of the given scales."""
    out = []
    for a in scales:
        n = int(min(10 * a, len(x))) or 1
        t = np.arange(n) - (n - 1) / 2
        w = 2 / (np.sqrt(3 * a) * np.pi**0.25) * (1 - (t / a) ** 2) * np.exp(-(t**2) / (2 * a * a))
        out.append(np.convolve(x, w, mode="same")[: len(x)])
    return np.array(out)


#: Level of silence, in dB, and least frequency that counts in the loudest spectrum.
SILENCE, NOISE_FROM = -100.0, 1000


def decibels(power: np.ndarray | float) -> np.ndarray:
    """Power in dB; what is below 1e-10 counts as that, and at most 80 dB below the loudest."""
    x = 10 * np.log10(np.maximum(power, 1e-10))
    return np.maximum(x, x.max() - 80)


LEVELS = ("log_magnitude", "log_energy", "log_peak", "win_max_magnitude", "stft_max_magnitude")


def level(x: np.ndarray, kind: str = "stft_max_magnitude", size: int = 1024, rate: int = 22050) -> float:
    """Level of a noise in dB, at least that of silence: of its mean power, energy or peak, of its loudest window, or of
    the loudest frame of its spectrum from NOISE_FROM on (magnitudes added up)."""
    if kind not in LEVELS:
        raise ValueError(f"no level {kind}")
    if not len(x) or not np.abs(x).max():
        return SILENCE
    if kind == "stft_max_magnitude":
        mirrored = np.pad(x, size // 2)  # zeros beyond the ends
        frames = np.lib.stride_tricks.sliding_window_view(mirrored, size)[:: size // 4]
        part = np.abs(np.fft.rfft(frames * hann(size), axis=1))[:, size * NOISE_FROM // rate :]
        return max(float(decibels(part.sum(1) ** 2).max()), SILENCE)
    if kind == "win_max_magnitude" and len(x) >= size:
        starts = np.arange(len(x) // size * 4) * size // 4
        return max(float(max(level(x[a : a + size], "log_magnitude") for a in starts)), SILENCE)
    power = {"log_energy": np.sum, "log_peak": np.max}.get(kind, np.mean)(x**2)
    return max(float(decibels(np.array([power]))[0]), SILENCE)


def noise_level_(x: np.ndarray, kind: str = "stft_max_magnitude", size: int = 1024, scale: float = 10.0) -> float:
    """The level of a noise, in tens of dB."""
    return level(x, kind, int(size)) / scale


def is_breath_(x: np.ndarray, cap: float = 24.0, kind: str = "stft_max_magnitude", size: int = 1024) -> bool:
    return level(x, kind, int(size)) > cap


def coloured_noise(n: int, decay: float, seed: int) -> np.ndarray:
    """Noise whose spectrum falls as 1 / f^decay, of RMS 1."""
    rng = np.random.default_rng(seed)
    s = np.fft.rfft(rng.standard_normal(n))
    f = np.maximum(np.arange(len(s)), 1)
    x = np.fft.irfft(s / f ** (decay / 2), n)
    return x / max(float(np.sqrt((x * x).mean())), 1e-12)


def convolved_(x: np.ndarray, response: list) -> np.ndarray:
    """Convolution with an impulse response, at the level of the input."""
    y = np.convolve(x, np.asarray(response, float))[: len(x)]
    top = np.abs(y).max()
    return y * (np.abs(x).max() / top) if top > 0 else y


def warped_(s: np.ndarray, alpha: float) -> np.ndarray:
    """Frequency axis of a spectrogram stretched by alpha, linearly interpolated."""
    k = np.arange(s.shape[1])
    return np.stack([np.interp(np.minimum(k * alpha, k[-1]), k, row) for row in s])


def block_masked(s: np.ndarray, share: float, width: int, seed: int) -> np.ndarray:
    """Blocks of frames set to 0 at random places, about the given share of all."""
    out, rng = s.copy(), np.random.default_rng(seed)
    for a in rng.integers(0, max(1, len(s) - width + 1), int(np.ceil(share * len(s) / width))):
        out[a : a + width] = 0
    return out


def enhanced_(x: np.ndarray) -> np.ndarray:
    """A track with zeros filled by straight lines, smoothed over five values around the ends, without negatives."""
    live = np.flatnonzero(x > 0)
    if not len(live):
        return x
    y = np.interp(np.arange(len(x)), live, x[live])
    near = np.stack([np.roll(y, k) for k in (-2, -1, 0, 1, 2)])
    return np.maximum(near.mean(0), 0)


def overlap_blocks(x: np.ndarray, size: int) -> np.ndarray:
    """Blocks that overlap by half, under a Hann window whose sum is 1."""
    return framed(np.pad(x, (size // 2, size)), size, size // 2, False) * hann(size)


def overlap_sum(blocks: np.ndarray, length: int) -> np.ndarray:
    size = blocks.shape[1]
    out = np.zeros(size + (size // 2) * (len(blocks) - 1))
    for i, b in enumerate(blocks):
        out[i * (size // 2) : i * (size // 2) + size] += b
    return out[size // 2 : size // 2 + length]


inverse_preemphasis = kernel(inverse_preemphasis_, VECTOR)
magnitude = kernel(magnitude_, MATRIX)
mel = kernel(mel_, MATRIX)
mel_inverse = kernel(mel_inverse_, MATRIX)
pitch = kernel(pitch_, VECTOR)
lpc = kernel(lpc_, MATRIX)
envelope = kernel(envelope_, MATRIX)
noise_level = kernel(noise_level_, T.DoubleType())
is_breath = kernel(is_breath_, T.BooleanType())
block_mask = kernel(lambda s, share, width, seed: block_masked(s, float(share), int(width), int(seed)), MATRIX)
convolved = kernel(convolved_, VECTOR)
warped = kernel(warped_, MATRIX)
enhanced = kernel(enhanced_, VECTOR)
wavelet = kernel(wavelet_, MATRIX)


def dithered(wave: Column, level: float, seed: int) -> Column:
    """The wave with a repeatable normal noise of the given level, by the hash of place and seed."""
    u = lambda i, k: (F.shiftrightunsigned(F.xxhash64(i, F.lit(seed + k)), 11) + 1) / F.lit(float(2**53 + 1))
    return F.transform(wave, lambda x, i: x + level * F.sqrt(-2 * F.ln(u(i, 0))) * F.cos(2 * np.pi * u(i, 1)))


def gain_curve(wave: Column, points: list[float]) -> Column:
    """Volume that follows a line through the given factors, evenly spaced over the wave."""
    curve = N.resample(F.array(*map(F.lit, points)), F.size(wave))
    return F.zip_with(wave, curve, lambda x, g: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * g)))


def clipped_at(values: Column, share: Column) -> Column:
    """A wave clipped to a quantile of its absolute values (nearest rank)."""
    top = F.get(F.array_sort(F.transform(values, F.abs)), F.least(F.floor(share * F.size(values)), F.size(values) - 1).cast("int"))
    return N.let(top, lambda t: F.transform(values, lambda x: F.greatest(-t, F.least(t, x))))


RATE_CURVES = ("constant", "fall", "parabola", "down", "up", "question")


def rate_curve(n: Column, kind: str, depth: float = 0.2) -> Column:
    """Speaking rate over n segments: a constant, or a curve of the given depth around 1."""
    at = lambda i: F.when(n > 1, i / (n - 1)).otherwise(F.lit(0.0))
    shape = {"constant": lambda t: F.lit(0.0), "fall": lambda t: 1 - t, "parabola": lambda t: 4 * t * (1 - t), "down": lambda t: -t, "up": lambda t: t, "question": lambda t: t * t}[kind]
    return F.transform(N.indices(n), lambda i: 1 + depth * shape(at(i)))


def pause_fades(wave: Column, rate: int, spans: Column, silent: Column) -> Column:
    """The wave with fades inside its silent units: from the edge of each neighbour that is no silence the volume goes
    to nothing along a fade curve over half the unit; where the neighbour is silence or the end, that half is zero."""

    def gain(k: Column) -> Column:
        def one(s: Column, j: Column) -> Column:
            a, b = F.floor(s["begin"] * rate), F.floor(s["end"] * rate)
            t = (k - a) / F.greatest(b - a, F.lit(1))
            before = (j > 0) & ~F.coalesce(F.get(silent, F.greatest(j - 1, F.lit(0))), F.lit(True))
            after = (j < F.size(spans) - 1) & ~F.coalesce(F.get(silent, F.least(j + 1, F.size(spans) - 1)), F.lit(True))
            curve = lambda x: F.pow(F.lit(10.0), 4 * (1 - 2 * x)) / 1e4
            g = F.when(t < 0.5, F.when(before, curve(2 * t)).otherwise(0.0)).otherwise(F.when(after, curve(2 - 2 * t)).otherwise(0.0))
            return F.when(F.get(silent, j) & (k >= a) & (k < b), g)

        hits = F.filter(F.transform(spans, one), lambda g: g.isNotNull())
        return F.coalesce(F.get(hits, F.lit(0)), F.lit(1.0))

    return F.transform(wave, lambda x, k: x * gain(k))


def gap_margins_cleared_(x: np.ndarray, gap: int = 20, width: int = 8) -> np.ndarray:
    """A track with zeros over so many values on both sides of every long run of zeros."""
    out = x.copy()
    edges = np.flatnonzero(np.diff(np.r_[0, (x <= 0).astype(int), 0]))
    for a, b in zip(edges[::2], edges[1::2]):
        if b - a >= gap:
            out[max(0, a - int(width)) : b + int(width)] = 0
    return out


def curvature_(x: np.ndarray) -> np.ndarray:
    """Angles, at the first and the last value of a segment, between the level and the line to a point in its middle: the
    median of the inner values, where the inner value of the middle rank stands. Zeros for one value and for sums below
    0.5. At the last value the level points back, and its line goes by places from 1."""
    n = len(x)
    if n == 1 or x.sum() < 0.5:
        return np.zeros(2)
    inner = x[1:-1]
    at, middle = (1 + int(np.argsort(inner)[len(inner) // 2]), float(np.median(inner))) if n > 2 else (n, float(x[-1]))
    first = -math.atan2(middle - x[0], at)
    if n == 2:
        return np.array([first, first])
    last = math.pi - math.atan2(middle - x[-1], at - n)
    return np.array([first, last - 2 * math.pi if last > math.pi else last])


def contour_(x: np.ndarray, points: int = 80, edge: int = 10) -> np.ndarray:
    """A track in so many points, with lines carried on at both ends and cut off again, mean 0."""
    n = int(points) + 2 * int(edge)
    y = np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x)[int(edge) : n - int(edge)]
    return y - y.mean()


def pitch_image_(x: np.ndarray, rate: float, size: int = 1024, hop: int = 256, bands: int = 40, low: float = 60.0, high: float = 500.0) -> np.ndarray:
    """Normalised difference of each frame at lags of evenly spaced semitones."""
    frames = framed(x, int(size), int(hop))
    half = int(size) // 2
    lags = np.minimum(half - 1, np.round(rate / (low * (high / low) ** np.linspace(0, 1, int(bands))))).astype(int)
    d = np.stack([((frames[:, :half] - frames[:, t : t + half]) ** 2).sum(1) for t in range(half)], 1)
    c = np.cumsum(d, 1)
    return np.stack([d[:, t] * t / np.maximum(c[:, t], 1e-12) for t in lags], 1)


gap_margins_cleared = kernel(gap_margins_cleared_, VECTOR)
curvature = kernel(curvature_, VECTOR)
contour = kernel(contour_, VECTOR)
pitch_image = kernel(pitch_image_, MATRIX)
