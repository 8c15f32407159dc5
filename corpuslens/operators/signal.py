"""Statistics over tables of samples (clip_id, channel, idx, v, sample_rate)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.scalars import note_of
from corpuslens.session import ensure_on_workers

CLIPPED = 0.999


def mono(samples: DataFrame) -> DataFrame:
    """Mean of the channels at each index."""
    return samples.groupBy("clip_id", "idx").agg(F.avg("v").alias("v"), F.max("sample_rate").alias("sample_rate"))


def db(c: Column) -> Column:
    return 20 * F.log10(c + 1e-12)


def level_stats(samples: DataFrame) -> DataFrame:
    """(clip_id, n, peak, rms, peak_db, rms_db, clipped)."""
    s = samples.groupBy("clip_id").agg(F.count("*").alias("n"), F.max(F.abs("v")).alias("peak"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.count_if(F.abs("v") >= CLIPPED).alias("clipped"))
    return s.withColumns({"peak_db": db(F.col("peak")), "rms_db": db(F.col("rms"))})


def stereo_stats(samples: DataFrame) -> DataFrame:
    """(clip_id, correlation, width, mid_rms, side_rms) of channels 0 and 1; uncentred correlation."""
    p = samples.where("channel < 2").groupBy("clip_id", "idx").agg(F.max(F.when(F.col("channel") == 0, F.col("v"))).alias("l"), F.max(F.when(F.col("channel") == 1, F.col("v"))).alias("r")).where("l is not null and r is not null")
    left, right = F.col("l"), F.col("r")
    s = p.groupBy("clip_id").agg(F.sum(left * right).alias("lr"), F.sum(left * left).alias("ll"), F.sum(right * right).alias("rr"), F.sqrt(F.avg((left + right) * (left + right) / 4)).alias("mid_rms"), F.sqrt(F.avg((left - right) * (left - right) / 4)).alias("side_rms"))
    c = F.when((F.col("ll") > 0) & (F.col("rr") > 0), F.col("lr") / F.sqrt(F.col("ll") * F.col("rr"))).otherwise(0.0)
    return s.select("clip_id", c.alias("correlation"), (1 - F.abs(c)).alias("width"), "mid_rms", "side_rms")


def envelope(samples: DataFrame, w: int) -> DataFrame:
    """(clip_id, slice, min, max, clipped) of w equal slices."""
    n = samples.groupBy("clip_id").agg((F.max("idx") + 1).alias("n"))
    s = samples.join(n, "clip_id").withColumn("slice", F.floor(F.col("idx") * w / F.col("n")).cast("int"))
    return s.groupBy("clip_id", "slice").agg(F.min("v").alias("min"), F.max("v").alias("max"), (F.max(F.abs("v")) >= CLIPPED).alias("clipped"))


def loudest_moment(samples: DataFrame, seconds: float = 0.05) -> DataFrame:
    """(clip_id, at_s, level_db): the block with the highest mean square, the first on a tie; its middle."""
    size = F.greatest(F.floor(F.col("sample_rate") * seconds + 0.5), F.lit(1)).cast("long")
    b = samples.withColumns({"_n": size, "block": (F.col("idx") - F.col("idx") % size) / size}).groupBy("clip_id", "block").agg(F.avg(F.col("v") * F.col("v")).alias("ms"), F.max("_n").alias("n"), F.max("sample_rate").alias("rate"))
    best = b.groupBy("clip_id").agg(F.max_by(F.struct("block", "ms", "n", "rate"), F.struct("ms", -F.col("block"))).alias("b"))
    return best.select("clip_id", ((F.col("b.block") + 0.5) * F.col("b.n") / F.col("b.rate")).alias("at_s"), db(F.sqrt("b.ms")).alias("level_db"))


def amplitude_histogram(samples: DataFrame, bins: int = 256) -> DataFrame:
    """(clip_id, bin, n) of -1..1 in equal bins; values outside go to the end bins."""
    k = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("v") + 1) / 2 * bins)))
    return samples.groupBy("clip_id", k.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def _window(name: str, n: int):
    import numpy as np

    t = 2 * np.pi * np.arange(n) / max(1, n - 1)
    return {"hann": 0.5 - 0.5 * np.cos(t), "hamming": 0.54 - 0.46 * np.cos(t), "blackman": 0.42 - 0.5 * np.cos(t) + 0.08 * np.cos(2 * t), "rect": np.ones(n)}[name]


def _periodic_hann(n: int):
    import numpy as np

    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def clip_lengths(samples: DataFrame) -> DataFrame:
    """(clip_id, n, rate): n counts up to the last index."""
    return samples.groupBy("clip_id").agg((F.max("idx") + 1).alias("n"), F.max("sample_rate").alias("rate"))


def _by_stretch(samples: DataFrame, fft: int, hop: int, together: Column, work, schema: str, before: int = 0, after: int = 0) -> DataFrame:
    """Rows of work() for each stretch of `together` frames of each clip; a frame is fft samples, every hop samples.

    work(clip_id, stretch, first, frames, n, rate): frames is a matrix of the stretch's frames with `before` frames ahead of
    them and `after` behind, as far as the clip has them; first is the number of its first row. Channels are averaged, and
    missing samples are 0. A sample goes to the stretches whose frames hold it, so a task has one stretch in memory and a
    long clip is many tasks.
    """
    ensure_on_workers(samples.sparkSession)
    whole = samples.join(clip_lengths(samples).withColumn("together", together.cast("long")), "clip_id")
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - fft + 1) / hop)).cast("long")
    last = F.floor(F.col("idx") / hop)
    reach = F.sequence(F.greatest(F.lit(0), F.floor((first - after) / F.col("together"))), F.floor((last + before) / F.col("together")))
    dealt = whole.select("clip_id", "n", "rate", "together", F.explode(reach).alias("stretch"), "idx", F.col("v").cast("double").alias("v"))

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        n, rate, together = (int(pdf[c].iloc[0]) for c in ("n", "rate", "together"))
        own = int(key[1]) * together
        low, high = max(0, own - before), min((n - fft) // hop + 1, own + together + after)
        if high <= own:
            return pd.DataFrame()
        start, size = low * hop, (high - low - 1) * hop + fft
        at = pdf["idx"].to_numpy() - start
        inside = (at >= 0) & (at < size)
        total = np.bincount(at[inside], pdf["v"].to_numpy()[inside], size)
        x = total / np.maximum(np.bincount(at[inside], minlength=size), 1)
        return work(key[0], int(key[1]), low, np.lib.stride_tricks.sliding_window_view(x, fft)[::hop], n, rate, together)

    return dealt.groupBy("clip_id", "stretch").applyInPandas(run, schema)


def _kind(samples: DataFrame) -> str:
    return dict(samples.dtypes)["clip_id"]


def spectrogram(samples: DataFrame, fft: int = 2048, hop: int | None = None, window: str = "hann", together: int = 512) -> DataFrame:
    """(clip_id, frame, rate, db array) of the mean of the channels: magnitude over the window's sum, doubled, in dB.

    A task transforms `together` consecutive frames at once, so a long clip spreads over all tasks.
    """
    hop = hop or fft // 4

    def work(clip, stretch, first, frames, n, rate, together):
        import numpy as np
        import pandas as pd

        w = _window(window, fft)
        m = np.abs(np.fft.rfft(frames * w, axis=1))[:, : fft // 2] / w.sum() * 2
        return pd.DataFrame({"clip_id": [clip] * len(m), "frame": first + np.arange(len(m)), "rate": [rate] * len(m), "db": list(20 * np.log10(m + 1e-12))})

    return _by_stretch(samples, fft, hop, F.lit(together), work, f"clip_id {_kind(samples)}, frame long, rate long, db array<double>")


def spectrum_stats(spec: DataFrame) -> DataFrame:
    """(clip_id, peak_hz, low_hz, high_hz, dynamic_range) of a spectrogram.

    The loudest bin of all frames (the earliest frame, then the lowest bin on a tie); the band within 60 dB of it, bin 0 left
    out (null when only that is as loud); its distance from the 10th-percentile bin among those whose loudest moment is above
    -120 dB, 0 when there is none.
    """
    each = spec.select("clip_id", "rate", "frame", F.size("db").alias("n"), F.posexplode("db").alias("bin", "db"))
    bins = each.groupBy("clip_id", "bin").agg(F.max(F.struct("db", (-F.col("frame")).alias("early"))).alias("top"), F.max("rate").alias("rate"), F.max("n").alias("n"))
    per = bins.groupBy("clip_id").agg(
        F.max(F.struct("top.db", "top.early", (-F.col("bin")).alias("low"))).alias("peak"),
        F.max("rate").alias("rate"),
        F.max("n").alias("n"),
        F.sort_array(F.collect_list(F.struct("bin", "top.db"))).alias("all"),  # a row of the transform's bins
    )
    hz = lambda bin_: bin_ / F.col("n") * (F.col("rate") / 2)
    near = F.transform(F.filter("all", lambda x: (x["bin"] > 0) & (x["db"] >= F.col("peak.db") - 60)), lambda x: x["bin"])
    loud = F.sort_array(F.transform(F.filter("all", lambda x: x["db"] > -120), lambda x: x["db"]))
    floor = F.coalesce(F.get(loud, F.floor(F.size(loud) * 0.1).cast("int")), F.col("peak.db"))
    return per.select("clip_id", hz(-F.col("peak.low")).alias("peak_hz"), hz(F.array_min(near)).alias("low_hz"), hz(F.array_max(near)).alias("high_hz"), (F.col("peak.db") - floor).alias("dynamic_range"))


def spectral_centroid(samples: DataFrame, fft: int = 4096, together: int = 256) -> DataFrame:
    """(clip_id, centroid_hz): magnitude-weighted mean frequency, mean over frames that don't overlap; silent frames count as 0.

    Null for clips shorter than a frame. Periodic Hann window, true transform.
    """

    def work(clip, stretch, first, frames, n, rate, together):
        import numpy as np
        import pandas as pd

        m = np.abs(np.fft.rfft(frames * _periodic_hann(fft), axis=1))[:, : fft // 2]
        total = m.sum(axis=1)
        weighted = (m * (np.arange(fft // 2) * rate / fft)).sum(axis=1)
        centres = np.divide(weighted, total, out=np.zeros(len(m)), where=total > 1e-12)
        return pd.DataFrame({"clip_id": [clip], "frames": [len(m)], "total": [float(centres.sum())]})

    parts = _by_stretch(samples, fft, fft, F.lit(together), work, f"clip_id {_kind(samples)}, frames long, total double")
    found = parts.groupBy("clip_id").agg((F.sum("total") / F.sum("frames")).alias("centroid_hz"))
    return clip_lengths(samples).select("clip_id").join(found, "clip_id", "left")


# ---- loudness: two filters in a row as one affine map of four numbers ---------------------------------------------


def _biquads(rate: float):
    """The two K-weighting filters for a sample rate, as (b, a): a high shelf and a high pass in their textbook forms.

    Frequencies, qualities and the gain in dB are fixed values of the loudness standard.
    """
    shelf_hz, shelf_db, shelf_q = 1681.974450955533, 3.999843853973347, 0.7071752369554196
    pass_hz, pass_q = 38.13547087602444, 0.5003270373238773
    gain = 10 ** (shelf_db / 40)
    w = 2 * math.pi * shelf_hz / rate
    up, down, c = gain + 1, gain - 1, math.cos(w)
    edge = 2 * math.sqrt(gain) * math.sin(w) / (2 * shelf_q)
    a0 = up - down * c + edge
    shelf = [gain * (up + down * c + edge) / a0, -2 * gain * (down + up * c) / a0, gain * (up + down * c - edge) / a0], [2 * (down - up * c) / a0, (up - down * c - edge) / a0]
    w = 2 * math.pi * pass_hz / rate
    c, alpha = math.cos(w), math.sin(w) / (2 * pass_q)
    high = [(1 + c) / 2 / (1 + alpha), -(1 + c) / (1 + alpha), (1 + c) / 2 / (1 + alpha)], [-2 * c / (1 + alpha), (1 - alpha) / (1 + alpha)]
    return [shelf, high]


class Cascade:
    """Two second-order filters in a row: state' = step @ state + gain * x, output = look @ state + direct * x, for stretches of samples.

    A stretch's output is what it gives from a state of zeros, plus its response to the state before it; both are matrix
    products over blocks of samples.
    """

    def __init__(self, rate: float, block: int = 256):
        import numpy as np

        (b, a), (c, d) = _biquads(rate)
        self.step = np.array([[-a[0], 1, 0, 0], [-a[1], 0, 0, 0], [c[1] - d[0] * c[0], 0, -d[0], 1], [c[2] - d[1] * c[0], 0, -d[1], 0]])
        self.gain = np.array([b[1] - a[0] * b[0], b[2] - a[1] * b[0], b[0] * (c[1] - d[0] * c[0]), b[0] * (c[2] - d[1] * c[0])])
        self.look, self.direct, self.block = np.array([c[0], 0.0, 1.0, 0.0]), b[0] * c[0], block
        powers = [np.eye(4)]
        for _ in range(block):
            powers.append(self.step @ powers[-1])
        self.powers = powers
        self.seen = np.array([self.look @ p for p in powers[:block]])  # what the state before a block adds to each output
        echo = np.r_[self.direct, [self.look @ p @ self.gain for p in powers[: block - 1]]]
        i = np.arange(block)
        self.own = np.where(i[:, None] >= i, echo[np.maximum(i[:, None] - i, 0)], 0.0)
        self.into = np.stack([powers[block - 1 - k] @ self.gain for k in range(block)], axis=1)  # what each sample leaves in the state

    def run(self, x):
        """(output from a state of zeros, state after, response to the state before as a row a sample, its power over all samples)."""
        import numpy as np

        n, size = len(x), self.block
        whole = n // size
        body = x[: whole * size].reshape(-1, size)
        out, left = body @ self.own.T, body @ self.into.T
        state, passed, answers = np.zeros(4), np.eye(4), np.empty((n, 4))
        for k in range(whole):
            out[k] += self.seen @ state
            answers[k * size : (k + 1) * size] = self.seen @ passed
            state, passed = self.powers[size] @ state + left[k], self.powers[size] @ passed
        rest = x[whole * size :]
        m = len(rest)
        tail = self.own[:m, :m] @ rest + self.seen[:m] @ state
        answers[whole * size :] = self.seen[:m] @ passed
        if m:
            state, passed = self.powers[m] @ state + self.into[:, size - m :] @ rest, self.powers[m] @ passed
        return np.r_[out.ravel(), tail], state, answers, passed


def loudness(samples: DataFrame, piece: int = 1 << 18) -> DataFrame:
    """(clip_id, lufs): K-weighted mean square of the mean of the channels, -0.691 + 10 log10; no gating. Silence gives -300.691.

    Missing samples are 0. Clips are cut into pieces that are filtered alone, from a state of zeros. With y that output and R
    the response to the four numbers s that the filters hold before the piece, its sum of squares is
    yy + 2 s Ry + s RR s, and after it they hold M s + c. Each piece gives yy, Ry, RR, M and c, a few dozen numbers; these
    are chained piece by piece, which is exact however the clip is cut, and no sample is read twice.
    """
    ensure_on_workers(samples.sparkSession)
    at = F.floor(F.col("idx") / piece).cast("long")
    clips = clip_lengths(samples)
    heard = samples.join(clips, "clip_id").select("clip_id", "n", "rate", at.alias("piece"), (F.col("idx") - at * piece).alias("at"), F.col("v").cast("double").alias("v"))
    every = clips.select("clip_id", "n", "rate", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / piece))).alias("piece"), F.lit(-1).cast("long").alias("at"), F.lit(0.0).alias("v"))
    dealt = heard.unionByName(every)  # a piece without a sample is there too
    kind = _kind(samples)

    def filtered(key, pdf):
        import numpy as np
        import pandas as pd

        size, rate = min(piece, int(pdf["n"].iloc[0]) - int(key[1]) * piece), float(pdf["rate"].iloc[0])
        pdf = pdf[pdf["at"] >= 0]
        total = np.bincount(pdf["at"], pdf["v"], size)
        y, after, answers, passed = Cascade(rate).run(total / np.maximum(np.bincount(pdf["at"], minlength=size), 1))
        facts = np.r_[float(y @ y), answers.T @ y, (answers.T @ answers).ravel(), passed.ravel(), after]
        return pd.DataFrame({"clip_id": [key[0]], "piece": [key[1]], "n": [size], "facts": [facts]})

    def chained(batches):
        import numpy as np
        import pyarrow as pa

        clip, state, sums, begun = None, np.zeros(4), [0, 0.0], False
        for b in batches:
            done = []
            for k, p, n, f in zip(*(c.to_pylist() for c in b.columns)):
                if not begun or k != clip:
                    if begun:
                        done.append((clip, *sums))
                    clip, state, sums, begun = k, np.zeros(4), [0, 0.0], True
                f = np.array(f)
                sums[0] += n
                sums[1] += f[0] + 2 * state @ f[1:5] + state @ f[5:21].reshape(4, 4) @ state
                state = f[21:37].reshape(4, 4) @ state + f[37:]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((b.column(0).type, pa.int64(), pa.float64()))], names=["clip_id", "n", "ss"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([clip], b.column(0).type), pa.array([sums[0]]), pa.array([sums[1]])], names=["clip_id", "n", "ss"])

    facts = dealt.groupBy("clip_id", "piece").applyInPandas(filtered, f"clip_id {kind}, piece long, n long, facts array<double>")
    sums = facts.repartition("clip_id").sortWithinPartitions("clip_id", "piece").mapInArrow(chained, f"clip_id {kind}, n long, ss double")
    return sums.select("clip_id", (-0.691 + 10 * F.log10(F.col("ss") / F.col("n") + 1e-30)).alias("lufs"))


# ---- pitch and tempo ----------------------------------------------------------------------------------------------


def differences(x, half: int):
    """Sum over j < half of (x[j] - x[j + t])**2 for each t < half, from one correlation by transform. Rounding is cut off."""
    import numpy as np

    size = 1 << (3 * half - 1).bit_length()
    head, both = np.zeros(size), np.zeros(size)
    head[:half], both[: 2 * half - 1] = x[:half], x[: 2 * half - 1]
    common = np.fft.irfft(np.conj(np.fft.rfft(head)) * np.fft.rfft(both), size)[:half]
    upto = np.r_[0.0, np.cumsum(x[: 2 * half - 1] ** 2)]
    energy = upto[half] + upto[half : 2 * half] - upto[:half]
    d = energy - 2 * common
    return np.where(d > 1e-12 * energy, d, 0.0)


def pitch(samples: DataFrame, size: int = 4096, threshold: float = 0.15) -> DataFrame:
    """(clip_id, hz, note, cents): fundamental of `size` samples in the middle of each clip, by cumulative mean normalised difference.

    The first lag from 2,000 Hz down to 20 Hz whose normalised difference is under the threshold, followed down to the bottom
    of its dip, then refined by a parabola. Null for silence, for clips of under size / 2 samples, when nothing repeats, and
    beyond 20 to 5,000 Hz. Channels are averaged. Only the middle leaves the scan.
    """
    mid = F.floor(F.col("n") / 2)
    start = F.greatest(F.lit(0), mid - size // 2)
    near = samples.join(clip_lengths(samples), "clip_id").where((F.col("idx") >= start) & (F.col("idx") < start + size))
    near = near.select("clip_id", "rate", F.least(F.col("n") - start, F.lit(size)).alias("len"), (F.col("idx") - start).alias("at"), F.col("v").cast("double").alias("v"))

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        n, rate, hz = int(pdf["len"].iloc[0]), float(pdf["rate"].iloc[0]), None
        if n >= size / 2:
            x = np.bincount(pdf["at"], pdf["v"], n) / np.maximum(np.bincount(pdf["at"], minlength=n), 1)
            half = n // 2
            d = differences(x, half)
            seen = np.cumsum(d[1:])
            c = np.r_[1.0, np.divide(d[1:] * np.arange(1, half), seen, out=np.full(half - 1, np.inf), where=seen > 0)]
            low, high = max(2, math.floor(rate / 2000)), min(half - 1, math.floor(rate / 20))
            under = np.flatnonzero(c[low:high] < threshold)
            if len(under):
                t = low + int(under[0])
                while t + 1 < high and c[t + 1] < c[t]:
                    t += 1
                shift = 0.0
                if 0 < t < half - 1:
                    bend = 2 * (c[t - 1] - 2 * c[t] + c[t + 1])
                    shift = (c[t - 1] - c[t + 1]) / bend if bend else 0.0
                hz = rate / (t + (shift if abs(shift) < 1 else 0.0))
                hz = hz if 20 <= hz <= 5000 else None
        return pd.DataFrame({"clip_id": [key[0]], "hz": pd.Series([hz], dtype="float64")})

    found = near.groupBy("clip_id").applyInPandas(run, f"clip_id {_kind(samples)}, hz double")
    found = found.withColumn("hz", F.nullif(F.col("hz"), F.lit(float("nan"))))
    note = note_of("hz")
    return found.select("clip_id", "hz", note["note"].alias("note"), note["cents"].alias("cents"))


#: Frames on either side that a local mean of the flux takes.
AROUND = 8


def onsets(samples: DataFrame, fft: int = 1024, hop: int = 512, together: int = 2048) -> DataFrame:
    """(clip_id, stretch, o array): onset strengths of consecutive frames, `together` a stretch (or a second and two frames, if that is more).

    The flux of a frame is the sum of what its magnitudes have gained since the frame before; where it is over 1.5 times the
    mean of 17 frames it is an onset, elsewhere 0, as in the first and last 8 frames. A stretch takes the frames it needs
    around it along, so it is worked out by itself.
    """

    def work(clip, stretch, first, frames, n, rate, together):
        import numpy as np
        import pandas as pd

        every = (n - fft) // hop  # the last whole frame isn't used
        m = np.abs(np.fft.rfft(frames * _periodic_hann(fft), axis=1))[:, : fft // 2]
        flux = np.zeros(len(m))
        flux[1:] = np.maximum(m[1:] - m[:-1], 0).sum(axis=1)
        upto = np.r_[0.0, np.cumsum(flux)]
        own = np.arange(stretch * together, min((stretch + 1) * together, every))
        o = np.zeros(len(own))
        inner = (own >= AROUND) & (own < every - AROUND)
        at = own[inner] - first
        mean = np.array([flux[k - AROUND : k + AROUND + 1].sum() for k in at]) / (2 * AROUND + 1)
        o[inner] = np.where((flux[at] > 1.5 * mean) & (flux[at] > 1e-9), flux[at], 0.0)
        return pd.DataFrame({"clip_id": [clip], "stretch": [stretch], "o": [o]}) if len(own) else pd.DataFrame()

    spread = F.greatest(F.lit(together), F.ceil(F.col("rate") / hop) + 2)
    return _by_stretch(samples, fft, hop, spread, work, f"clip_id {_kind(samples)}, stretch long, o array<double>", AROUND + 1, AROUND)


def tempo(samples: DataFrame, fft: int = 1024, hop: int = 512, together: int = 2048) -> DataFrame:
    """(clip_id, bpm): whole beats a minute, 60 to 200; null for silence, for clips of under a second's frames, and beyond that range.

    The lag with the highest autocorrelation of the onsets (the shortest on a tie), refined by a parabola. A stretch's
    onsets meet those that follow it within a second; one transform gives all its lags, and lags are summed over stretches.
    """
    found = onsets(samples, fft, hop, together)
    clips = clip_lengths(samples).withColumns({"frames": F.floor((F.col("n") - fft) / hop), "a_second": F.col("rate") / hop})
    clips = clips.withColumns({"low": F.floor(F.col("a_second") * 60 / 200), "high": F.ceil("a_second")})
    # the first onsets of a stretch go to the stretch before, which has them behind its own
    reach = found.join(clips.select("clip_id", "high"), "clip_id")
    mine = reach.select("clip_id", "stretch", "high", F.lit(0).alias("part"), "o")
    behind = reach.where("stretch > 0").select("clip_id", (F.col("stretch") - 1).alias("stretch"), "high", F.lit(1).alias("part"), F.slice("o", 1, (F.col("high") + 1).cast("int")).alias("o"))

    def correlate(key, pdf):
        import numpy as np
        import pandas as pd

        parts = {p: np.asarray(o, float) for p, o in zip(pdf["part"], pdf["o"])}
        own, lags = parts.get(0, np.zeros(0)), int(pdf["high"].iloc[0]) + 2
        both = np.r_[own, parts.get(1, np.zeros(0))]
        if not own.any():
            return pd.DataFrame()
        size = 1 << (len(both) + lags).bit_length()
        c = np.fft.irfft(np.conj(np.fft.rfft(own, size)) * np.fft.rfft(both, size), size)[:lags]
        c[c < 1e-9 * c[0]] = 0.0
        return pd.DataFrame({"clip_id": [key[0]] * lags, "lag": np.arange(lags), "c": c})

    lags = mine.unionByName(behind).groupBy("clip_id", "stretch").applyInPandas(correlate, f"clip_id {_kind(samples)}, lag long, c double")
    sums = lags.groupBy("clip_id", "lag").agg(F.sum("c").alias("c")).groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("lag", "c"))).alias("c"))
    in_range = F.filter("c", lambda x: (x["lag"] >= F.col("low")) & (x["lag"] <= F.col("high")))
    best = sums.join(clips.where("frames >= 4 and high < frames"), "clip_id").withColumn("best", F.array_max(F.transform(in_range, lambda x: F.struct(x["c"].alias("c"), (-x["lag"]).alias("early")))))
    lag = -F.col("best.early")
    value = lambda k: F.get("c", (lag + k).cast("int"))["c"]
    bend = value(-1) - 2 * value(0) + value(1)
    shift = F.when((lag > F.col("low")) & (lag < F.col("high")) & (F.abs(bend) > 1e-12), 0.5 * (value(-1) - value(1)) / bend)
    beats = 60 * F.col("a_second") / (lag + F.when(F.abs(shift) < 1, shift).otherwise(0.0))
    bpm = best.select("clip_id", F.when((beats >= 60) & (beats <= 200), F.floor(beats + 0.5)).cast("long").alias("bpm"))
    return clips.select("clip_id").join(bpm, "clip_id", "left")
