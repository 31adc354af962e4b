"""Language identification by a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.llm.common import bounded_sample, fold, unused

WINDOW, WIDTHS, CHANNELS, FILTERS = 192, (2, 3, 4), 8, 20
#: Letters, and numerals such as one half or the Roman four that are no letters.
LETTER_LIKE = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    """Whether a character of Unicode's letter categories (Lu, Ll, Lt, Lm, Lo) is in the text."""
    return any(m[0].isalpha() for m in LETTER_LIKE.finditer(text or ""))


@dataclass
class ByteCnn:
    """emb: (256, channels); filters: for each width (width * channels, filters); out: softmax layer. Byte 0 pads."""

    languages: list[str]
    emb: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """The same filters as look-up tables: one over all byte pairs for each two places of a filter, one over single bytes for an odd last place."""
        if not hasattr(self, "_tables"):
            self._tables = []
            for width, w in self.filters.items():
                w = w.reshape(width, self.emb.shape[1], -1)
                single = [(self.emb @ w[i]).astype(np.float32) for i in range(width)]
                pairs = [(single[i][None, :, :] + single[i + 1][:, None, :]).reshape(65536, -1) for i in range(0, width - 1, 2)]  # index: first + 256 * second
                self._tables.append(pairs + ([single[-1]] if width % 2 else []))
        return self._tables

    def log_probs(self, windows: np.ndarray, block: int = 256) -> np.ndarray:
        """(n, window) bytes -> (n, languages)."""
        got = []
        for at in range(0, len(windows), block):
            x = windows[at : at + block]
            two = x[:, :-1].astype(np.int64) + 256 * x[:, 1:].astype(np.int64)
            pooled = []
            for width, tables in zip(self.filters, self.tables(), strict=True):
                n = x.shape[1] - width + 1
                acts = np.take(tables[0], two[:, :n], axis=0)
                for k, table in enumerate(tables[1:], 1):
                    acts += np.take(table, two[:, 2 * k : 2 * k + n] if len(table) > 256 else x[:, width - 1 : width - 1 + n], axis=0)
                pooled.append(acts.max(axis=1))
            h = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
            z = h @ self.out + self.out_bias
            z -= z.max(axis=1, keepdims=True)
            got.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(got) if got else np.empty((0, len(self.languages)))


def to_windows(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Whole texts cut into windows (the last one padded), and each window's text number."""
    counts = np.array([max(1, -(-len(t) // window)) for t in texts], dtype=np.int64)
    joined = b"".join(t.ljust(int(c) * window, b"\0") for t, c in zip(texts, counts, strict=True))
    return np.frombuffer(joined, dtype=np.uint8).reshape(-1, window), np.repeat(np.arange(len(texts)), counts)


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 12, rate: float = 4e-3, seed: int = 7) -> ByteCnn:
    """Adam on cross-entropy. The gradient of max pooling reaches one place per filter and window."""
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    p = {"emb": rng.normal(0, 0.5, (256, CHANNELS)), "bias": np.zeros(total), "out": rng.normal(0, 0.1, (total, len(languages))), "out_bias": np.zeros(len(languages))}
    p |= {w: rng.normal(0, 1 / np.sqrt(w * CHANNELS), (w * CHANNELS, FILTERS)) for w in WIDTHS}
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    weight = 1 / np.maximum(np.bincount(labels, minlength=len(languages)), 1)
    weight = weight / weight[labels].mean()
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            x, y = windows[rows], labels[rows]
            e = p["emb"][x]
            pooled, where = [], {}
            for w in WIDTHS:
                patches = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(rows), -1, w * CHANNELS)
                acts = patches @ p[w]
                where[w] = acts.argmax(axis=1)
                pooled.append(np.take_along_axis(acts, where[w][:, None, :], axis=1)[:, 0])
            pre = np.concatenate(pooled, axis=1) + p["bias"]
            h = np.maximum(pre, 0)
            z = h @ p["out"] + p["out_bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(y)), y] -= 1
            z *= weight[y][:, None] / len(y)
            g = {"out": h.T @ z + 1e-4 * p["out"], "out_bias": z.sum(axis=0)}
            dh = (z @ p["out"].T) * (pre > 0)
            g["bias"], g["emb"] = dh.sum(axis=0), np.zeros_like(p["emb"])
            for k, w in enumerate(WIDTHS):
                d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                places = where[w][:, :, None] + np.arange(w)[None, None, :]
                bytes_at = x[np.arange(len(rows))[:, None, None], places]
                g[w] = np.einsum("bf,bfwc->wcf", d, p["emb"][bytes_at]).reshape(w * CHANNELS, FILTERS)
                back = np.einsum("bf,wcf->bfwc", d, p[w].reshape(w, CHANNELS, FILTERS))
                np.add.at(g["emb"], bytes_at.ravel(), back.reshape(-1, CHANNELS))
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return ByteCnn(languages, p["emb"], {w: p[w] for w in WIDTHS}, p["bias"], p["out"], p["out_bias"])


def _window_udf(seed: int, per_text: int = 4):
    @F.pandas_udf("array<binary>")
    def pick(texts: pd.Series) -> pd.Series:
        def of(t: str | None) -> list[bytes]:
            b = (t or "").encode()
            if not has_letter(t):
                return []
            rng = np.random.default_rng(seed + len(b))
            starts = rng.integers(0, max(1, len(b) - WINDOW + 1), per_text - 1)
            short = int(rng.integers(8, WINDOW))  # a short piece too, as in short texts
            return [b[s : s + WINDOW] for s in {int(s) for s in starts}] + [b[:short]]

        return texts.map(of)

    return pick


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, seed: int = 7) -> ByteCnn | None:
    """Learns from text and lang of rows whose crc32(id as text) mod 3 is not 1; a null id counts as one of them.

    Bound of the sample: about per_language rows for each of the 256 most frequent languages (bounded_sample's max_strata;
    further ones are not learned), picked by a hash of id and text length, and four windows from each. The windows, not the texts, come to the driver. None if there is nothing to learn from.
    """
    rows = docs.where(F.coalesce(fold(id_col, 3), F.lit(0)) != 1).select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    some = bounded_sample(rows, "_lang", F.concat_ws(":", F.coalesce("_id", F.lit("")), F.length("_text")), per_language)
    found = some.select("_lang", _window_udf(seed)("_text").alias("w")).select("_lang", F.explode("w").alias("w")).orderBy("_lang", "w").collect()
    if not found:
        return None
    languages = sorted({r[0] for r in found})
    at = {x: i for i, x in enumerate(languages)}
    return fit(to_windows([bytes(r[1]) for r in found])[0], np.array([at[r[0]] for r in found]), languages, seed=seed)


def predict(text: Column, model: ByteCnn | None) -> Column:
    """struct<lang string, score double>: the language whose mean log-probability over all windows of the whole text
    is highest, and the mean of its window probabilities. `und` and 0 for a null text, a text without a letter, or
    without a model."""

    @F.pandas_udf("lang string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": 0.0})
        if model is None:
            return out
        step = 1 << 21  # bytes at once, so that very long texts don't add up
        pending: list[bytes] = []
        places: list[int] = []

        def flush() -> None:
            windows, of_text = to_windows(pending)
            lp = model.log_probs(windows)
            n = np.bincount(of_text, minlength=len(pending)).astype(float)
            mean = np.stack([np.bincount(of_text, weights=lp[:, k], minlength=len(pending)) / n for k in range(lp.shape[1])], axis=1)
            best = mean.argmax(axis=1)
            prob = np.bincount(of_text, weights=np.exp(lp[np.arange(len(lp)), best[of_text]]), minlength=len(pending)) / n
            out.loc[places, "lang"] = [model.languages[b] for b in best]
            out.loc[places, "score"] = np.clip(prob, 0, 1)
            pending.clear()
            places.clear()

        size = 0
        for i, t in enumerate(texts):
            if not has_letter(t):
                continue
            pending.append(t.encode())
            places.append(i)
            size += len(pending[-1])
            if size >= step:
                flush()
                size = 0
        if pending:
            flush()
        return out

    return of(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, held_out (false for a null id), lang_pred, score. Repeated rows each keep their row;
    other columns are left out; an empty table gives an empty result."""
    model = train(docs, id_col, text_col, lang_col)
    got = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(id_col, 3) == 1, F.lit(False)).alias("held_out"), predict(F.col(text_col), model).alias("_p"))
    return got.select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.4) -> DataFrame:
    """docs without those that are `und` or scored under `least`; all columns stay as they are."""
    model = train(docs, id_col, text_col, lang_col)
    name = unused("language", docs)
    told = docs.withColumn(name, predict(F.col(text_col), model))
    return told.where((F.col(f"{name}.lang") != UNKNOWN) & (F.col(f"{name}.score") >= least)).drop(name)
