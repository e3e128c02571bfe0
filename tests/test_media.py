"""Expansions of media marks: known counts of small images, and plain computations on many sizes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import media as M


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def size(w, h):
    return F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"))


def test_known_counts(spark):
    """A white image of 32 by 32 in every family; a sound of a tenth of a second."""
    text = lambda family: one(spark, M.expand_images(F.lit("a <image> b"), F.array(size(32, 32)), family))
    assert text("llava") == "a " + "<image>" * 576 + " b" and text("llava_next") == "a " + "<image>" * 1176 + " b"
    assert text("qwen2_vl") == "a <|vision_start|>" + "<|image_pad|>" * 4 + "<|vision_end|> b"
    assert text("pixtral") == "a [IMG][IMG][IMG_BREAK][IMG][IMG][IMG_END] b"
    assert text("intern_vl") == "a <img>" + "<IMG_CONTEXT>" * 256 + "</img> b"
    assert text("gemma3") == "a \n\n<start_of_image>" + "<image_soft_token>" * 256 + "<end_of_image>\n\n b"
    assert text("mllama") == "a <|image|> b" and text("paligemma") == "a  b"
    assert one(spark, M.qwen2_audio(F.lit(10))) == "<|audio_bos|>" + "<|AUDIO|>" * 2 + "<|audio_eos|>"
    assert one(spark, M.paligemma_ids(F.array(F.lit(5)), F.lit(1), 9)) == [9] * 256 + [5]
    assert one(spark, M.intern_vl_video(F.lit(2))) == "Frame1: <img>" + "<IMG_CONTEXT>" * 256 + "</img>\nFrame2: <img>" + "<IMG_CONTEXT>" * 256 + "</img>"
    assert one(spark, M.gemma3(F.lit(2))).count("<start_of_image>") == 3
    assert one(spark, M.qwen2_vl(size(56, 56), F.lit(5))).count("<|video_pad|>") == 3 * 4
    assert one(spark, M.expand_images(F.lit("<image><image>x<image>"), F.array(size(32, 32), size(64, 32)), "mllama")) == "<|image|><|image|>x<image>"
    with pytest.raises(ValueError):
        M.expand_images(F.lit(""), F.array(size(1, 1)), "none")


def plain_qwen(w, h):
    w, h = max(w, 28), max(h, 28)
    w, h = (h * 180, h) if w / h > 200 else (w, h)
    w, h = (w, w * 180) if h / w > 200 else (w, h)
    a, b = max(28, round(h / 28) * 28), max(28, round(w / 28) * 28)
    if a * b > 14 * 14 * 4 * 1280:
        beta = math.sqrt(h * w / (14 * 14 * 4 * 1280))
        a, b = max(28, math.floor(h / beta / 28) * 28), max(28, math.floor(w / beta / 28) * 28)
    elif a * b < 56 * 56:
        beta = math.sqrt(56 * 56 / (h * w))
        a, b = math.ceil(h * beta / 28) * 28, math.ceil(w * beta / 28) * 28
    return a // 14, b // 14


def plain_pixtral(w, h):
    ratio = max(w / 1024, h / 1024)
    w, h = (max(1, math.floor(w / ratio)), max(1, math.floor(h / ratio))) if ratio > 1 else (w, h)
    rows = [["[IMG]"] * ((w - 1) // 16 + 1) + ["[IMG_BREAK]"] for _ in range((h - 1) // 16 + 1)]
    flat = [t for r in rows for t in r]
    return "".join([*flat[:-1], "[IMG_END]"])


def plain_intern(w, h):
    best, far = None, math.inf
    for g in sorted(((a, b) for a in range(1, 13) for b in range(1, 13) if a * b <= 12), key=lambda g: g[0] * g[1]):
        d = abs(w / h - g[0] / g[1])
        if d < far or d == far and w * h > 0.5 * 448 * 448 * g[0] * g[1]:
            best, far = g, d
    n = best[0] * best[1]
    return n + (n > 1)


def plain_next(w, h):
    best = None
    for H, W in M.LLAVA_NEXT:
        scale = min(W / w, H / h)
        kept = min(int(w * scale) * int(h * scale), w * h)
        if best is None or kept > best[0] or kept == best[0] and H * W - kept < best[1]:
            best = (kept, H * W - kept, H // 336 * 24, W // 336 * 24)
    ch, cw = best[2:]
    if w / h > cw / ch:
        ch -= (ch - int(round(h * (cw / w), 7))) // 2 * 2
    else:
        cw -= (cw - int(round(w * (ch / h), 7))) // 2 * 2
    return ch * cw + ch + 576


def test_many_sizes(spark):
    rng = random.Random(6)
    sizes = [(rng.randint(1, 4000), rng.randint(1, 4000)) for _ in range(150)] + [(w, h) for w in (1, 14, 28, 42, 70, 448, 896, 1344, 5000) for h in (1, 14, 28, 42, 70, 448, 896, 1344, 5000)]
    df = spark.createDataFrame(sizes, "width int, height int").withColumn("s", F.struct("width", "height"))
    got = df.select("width", "height", M.qwen2_vl_grid(F.col("s")).alias("q"), M.pixtral(F.col("s")).alias("p"), M.intern_vl_tiles(F.col("s")).alias("i"), M.llava_next_tokens(F.col("s")).alias("n")).collect()
    for r in got:
        w, h = r.width, r.height
        assert tuple(r.q) == plain_qwen(w, h), (w, h)
        assert r.p == plain_pixtral(w, h) and r.i == plain_intern(w, h) and r.n == plain_next(w, h), (w, h)
