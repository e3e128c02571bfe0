"""What a mark for an image, a video or a sound becomes in the text of a model family: how many tokens, in which frames and rows.

Counts follow from sizes (width, height, frames, samples) alone, as each family's processor resizes, tiles and merges patches; all
are Columns. :func:`expand` puts the parts in the places of the marks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let
from .alignment import image_size

# Tokens and frames of the families, and the sizes that their processors work in.
GEMMA3 = ("\n\n<start_of_image>" + "<image_soft_token>" * 256 + "<end_of_image>\n\n", "Here is the original image ", " and here are some crops to help you see better ")
INTERN_VL = {"tile": 448, "tokens": 256, "least": 1, "most": 12}
LLAVA_NEXT = ((336, 672), (672, 336), (672, 672), (1008, 336), (336, 1008))
QWEN2_VL = {"patch": 14, "merge": 2, "least": 56 * 56, "most": 14 * 14 * 4 * 1280}
PIXTRAL = {"patch": 16, "longest": 1024}


def expand(text: Column, mark: str, parts: Column) -> Column:
    """``text`` with its i-th mark as the i-th of ``parts``; marks beyond them stay."""
    pieces = F.split(text, rf"\Q{mark}\E", -1)
    return let(parts, lambda p: F.array_join(F.transform(pieces, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.coalesce(F.get(p, i - 1), F.lit(mark)), x))), ""))


def llava(size: Column, token: str = "<image>", side: int = 336, patch: int = 14, additional: int = 1) -> Column:
    """Every image is resized to one square."""
    return F.repeat(F.lit(token), F.lit((side // patch) ** 2 + additional - 1))


def gemma3(crops: Column) -> Column:
    """An image, and its crops where there are some (pan and scan)."""
    whole, original, these = map(F.lit, GEMMA3)
    return F.when(crops > 0, F.concat(original, whole, these, F.array_join(F.array_repeat(whole, crops), " "))).otherwise(whole)


def qwen2_vl_grid(size: Column) -> Column:
    """struct<height, width> in patches, after the family's own bounds: sides of 28 at least, no side 200 times the other, whole merged patches, pixels within bounds."""
    patch, merge, least, most = (QWEN2_VL[k] for k in ("patch", "merge", "least", "most"))
    f = patch * merge

    def bounded(s: Column) -> Column:
        w, h = F.greatest(s["width"], F.lit(f)), F.greatest(s["height"], F.lit(f))
        return F.struct(F.when(w / h > 200, h * 180).otherwise(w).alias("w"), F.when(h / w > 200, w * 180).otherwise(h).alias("h"))

    def resized(s: Column) -> Column:
        near = lambda x: (F.greatest(F.bround(x / f), F.lit(1)) * f).cast("double")
        w, h = near(s["w"]), near(s["h"])
        down, up = F.sqrt(s["w"] * s["h"] / most), F.sqrt(least / (s["w"] * s["h"]))
        pick = lambda x, bar: F.when(w * h > most, F.greatest(F.lit(f), F.floor(x / down / f) * f)).when(w * h < least, F.ceil(x * up / f) * f).otherwise(bar)
        return F.struct((pick(s["h"], h) / patch).cast("int").alias("height"), (pick(s["w"], w) / patch).cast("int").alias("width"))

    return let(let(size, bounded), resized)


def qwen2_vl(size: Column, frames: Column | None = None) -> Column:
    """An image, or a video of so many frames of one size; frames are merged in pairs, the last one doubled if it is alone."""
    token = "<|image_pad|>" if frames is None else "<|video_pad|>"
    time = F.lit(1) if frames is None else F.ceil(frames / 2).cast("int")
    tokens = let(qwen2_vl_grid(size), lambda g: (time * g["height"] * g["width"] / QWEN2_VL["merge"] ** 2).cast("int"))
    return F.concat(F.lit("<|vision_start|>"), F.repeat(F.lit(token), tokens), F.lit("<|vision_end|>"))


def pixtral(size: Column) -> Column:
    """Rows of patches, each closed by a break, the last by an end; the longest side is 1024 at most."""
    patch, longest = PIXTRAL["patch"], PIXTRAL["longest"]

    def of(s: Column) -> Column:
        ratio = F.greatest(s["width"] / longest, s["height"] / longest)
        side = lambda x: F.when(ratio > 1, F.greatest(F.floor(x / ratio), F.lit(1))).otherwise(x)
        count = lambda x: (F.floor((side(x) - 1) / patch) + 1).cast("int")
        row = F.repeat(F.lit("[IMG]"), count(s["width"]))
        return F.concat(F.repeat(F.concat(row, F.lit("[IMG_BREAK]")), count(s["height"]) - 1), row, F.lit("[IMG_END]"))

    return let(size, of)


def intern_vl_tiles(size: Column) -> Column:
    """How many tiles an image is cut into: the grid whose shape is nearest to the image's, of equal ones the largest that the image half fills; a small whole image beside more than one."""
    tile, least, most = (INTERN_VL[k] for k in ("tile", "least", "most"))
    grids = sorted(((w, h) for w in range(1, most + 1) for h in range(1, most + 1) if least <= w * h <= most), key=lambda g: g[0] * g[1])

    def of(s: Column) -> Column:
        start = F.struct(F.lit(float("inf")).alias("far"), F.lit(0).alias("tiles"))

        def better(best: Column, g: Column) -> Column:
            far = F.abs(s["width"] / s["height"] - g["w"] / g["h"])
            n = g["w"] * g["h"]
            fills = s["width"].cast("long") * s["height"] > F.lit(0.5 * tile * tile) * n
            return F.when((far < best["far"]) | (far == best["far"]) & fills, F.struct(far.alias("far"), n.alias("tiles"))).otherwise(best)

        every = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in grids))
        return F.aggregate(every, start, better, lambda b: b["tiles"] + (b["tiles"] > 1).cast("int"))

    return let(size, of)


def intern_vl(tiles: Column) -> Column:
    return F.concat(F.lit("<img>"), F.repeat(F.lit("<IMG_CONTEXT>"), tiles * INTERN_VL["tokens"]), F.lit("</img>"))


def intern_vl_video(frames: Column) -> Column:
    """A line for each frame, which is one tile."""
    one = lambda i: F.concat(F.lit("Frame"), i.cast("string"), F.lit(": "), intern_vl(F.lit(1)))
    return F.when(frames > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(frames, F.lit(1))), one), "\n")).otherwise("")


def llava_next_tokens(size: Column, side: int = 336, patch: int = 14) -> Column:
    """Patches of the best of the family's resolutions, without those that are padding, a line end for each row, and the small whole image.

    Best is the resolution that keeps most of the image's pixels, of equal ones the one that wastes least, of these the first.
    """
    n = side // patch

    def of(s: Column) -> Column:
        def fit(h: int, w: int, i: int) -> Column:
            scale = F.least(F.lit(w) / s["width"], F.lit(h) / s["height"])
            kept = F.least(F.floor(s["width"] * scale) * F.floor(s["height"] * scale), (s["width"] * s["height"]).cast("long"))
            return F.struct(kept.alias("kept"), (kept - h * w).alias("waste"), F.lit(-i).alias("first"), F.lit(h // side * n).alias("h"), F.lit(w // side * n).alias("w"))

        best = F.greatest(*(fit(h, w, i) for i, (h, w) in enumerate(LLAVA_NEXT)))

        def unpadded(b: Column) -> Column:
            new_h = F.floor(F.round(s["height"] * (b["w"] / s["width"]), 7)).cast("int")
            new_w = F.floor(F.round(s["width"] * (b["h"] / s["height"]), 7)).cast("int")
            wide = s["width"] / s["height"] > b["w"] / b["h"]
            h = F.when(wide, b["h"] - 2 * F.floor((b["h"] - new_h) / 2).cast("int")).otherwise(b["h"])
            w = F.when(wide, b["w"]).otherwise(b["w"] - 2 * F.floor((b["w"] - new_w) / 2).cast("int"))
            return h * w + h + n * n

        return let(best, unpadded)

    return let(size, of)


def llava_next(size: Column, token: str = "<image>") -> Column:
    return F.repeat(F.lit(token), llava_next_tokens(size))


def qwen2_audio(frames: Column) -> Column:
    """A sound of so many spectrum frames, halved twice."""
    tokens = F.floor((F.floor((frames - 1) / 2) - 1) / 2) + 1
    return F.concat(F.lit("<|audio_bos|>"), F.repeat(F.lit("<|AUDIO|>"), F.greatest(tokens, F.lit(0)).cast("int")), F.lit("<|audio_eos|>"))


def paligemma_ids(ids: Column, images: Column, token: int, each: int = 256) -> Column:
    """The images' tokens stand before all ids, and their marks are not in the text."""
    return F.concat(F.array_repeat(F.lit(token), images * each), ids)


#: What an image of a size (struct<width, height>) becomes.
FAMILIES = {
    "llava": llava,
    "llava_next": llava_next,
    "gemma3": lambda size: gemma3(F.lit(0)),
    "qwen2_vl": qwen2_vl,
    "pixtral": pixtral,
    "intern_vl": lambda size: intern_vl(intern_vl_tiles(size)),
    "mllama": lambda size: F.lit("<|image|>"),
    "paligemma": lambda size: F.lit(""),
}


def expand_images(text: Column, sizes: Column, family: str, mark: str = "<image>") -> Column:
    """``text`` with each mark as its image (array<struct<width, height>>, in order) in a family; images are first brought within the bounds of pixels."""
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family}")
    within = F.transform(sizes, lambda s: image_size(s["width"], s["height"]))
    return expand(text, mark, F.transform(within, lambda s: FAMILIES[family](s)))
