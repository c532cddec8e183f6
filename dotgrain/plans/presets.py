"""Named settings, merged over the defaults and sanitised."""

from __future__ import annotations

from ..functions.params import sanitized

# The built-in presets.
BUILTIN = {
    "classic-bw": ("Classic B&W", dict(mode="halftone", density=110, radius=108, angle=45, blur=0.6, colorCount=2, spread=0, palette=["#111111", "#FFFFFF"], background="#FFFFFF", contrast=1.15)),
    "soft-print": ("Soft Print", dict(mode="halftone", density=80, radius=96, blur=2.4, colorCount=4, spread=0.2, palette=["#2B2B33", "#6E7A8A", "#C9BFAE", "#F3EDE2"], background="#F3EDE2", contrast=0.95, gamma=1.05, gradeBias=0.08, saturation=0.85)),
    "comic": ("Comic", dict(mode="halftone", density=70, radius=125, radiusCurve=0.15, angle=15, blur=1.2, colorCount=3, spread=0.55, palette=["#161616", "#F5EBD8", "#EC3E32"], background="#F5EBD8", contrast=1.45, gamma=0.95, gradeBias=0.12, saturation=1.25)),
    "newspaper": ("Newspaper", dict(mode="halftone", density=150, radius=112, angle=45, blur=0.8, colorCount=2, spread=0.1, palette=["#1A1815", "#DCD6C6"], background="#DCD6C6", contrast=1.35, gamma=1.1, blackPoint=10, whitePoint=245, gradeBias=-0.05, saturation=0.4)),
    "rgb-pop": ("RGB Pop", dict(mode="halftone", density=95, radius=132, radiusCurve=0.2, blur=1.0, colorCount=5, spread=0.75, paletteLocked=False, background="auto", contrast=1.3, gradeBias=0.15, saturation=1.6)),
    "retro-poster": ("Retro Poster", dict(mode="halftone", density=60, radius=118, radiusCurve=0.1, angle=30, blur=2.0, shape="diamond", colorCount=4, spread=0.5, palette=["#22201E", "#D9534F", "#E8B33C", "#EFE6D2"], background="#EFE6D2", contrast=1.2, gamma=1.15, gradeBias=0.1, saturation=1.1)),
    "offset-cmyk": ("Offset CMYK", dict(mode="halftone", screenMode="perInk", density=95, radius=106, shape="ellipse", dotGain=3, blur=0.5, colorCount=4, palette=["#1A1A1A", "#009EE0", "#E6007E", "#FFED00"], spread=0, background="#FFFFFF", contrast=1.05)),
    "risograph": ("Risograph", dict(mode="halftone", screenMode="perInk", density=70, radius=128, radiusCurve=0.1, dotGain=9, blur=1.6, edgeAware=True, colorCount=3, palette=["#0E1A6B", "#FF5A5F", "#3D3D3D"], spread=0, background="#F4F1E6", contrast=1.2, gamma=1.1, saturation=1.2)),
    "mac-classic": ("Mac Classic", dict(mode="dither", ditherAlgorithm="atkinson", ditherResolution=420, colorCount=2, palette=["#000000", "#FFFFFF"], spread=0, sharpen=60, sharpenRadius=1.5, contrast=1.15)),
    "newsprint-dither": ("Newsprint Dither", dict(mode="dither", ditherAlgorithm="cluster45", ditherResolution=700, colorCount=2, palette=["#1A1815", "#DCD6C6"], spread=0.1, blur=0.4, contrast=1.25, gamma=1.05, saturation=0.4)),
    "handheld-green": ("Handheld Green", dict(mode="dither", ditherAlgorithm="bayer4", ditherResolution=220, colorCount=4, palette=["#0F380F", "#306230", "#8BAC0F", "#9BBC0F"], spread=0, sharpen=40, contrast=1.2)),
    "blue-noise-photo": ("Blue Noise", dict(mode="dither", ditherAlgorithm="bluenoise", ditherResolution=900, colorCount=6, paletteLocked=False, spread=0.2, noiseReduction=25, sharpen=30, contrast=1.05, saturation=1.05)),
    "zone-poster": ("Zone Poster", dict(mode="dither", ditherAlgorithm="stucki", ditherResolution=500, colorCount=6, palette=["#141021", "#3B2D5C", "#B8456A", "#E8804F", "#F2C46B", "#FBF3DC"], spread=0.3, tonalMapping=True, shadowSplit=0.3, highlightSplit=0.68, contrast=1.2, saturation=1.15)),
}


def find(name: str) -> dict:
    """The parameters of a preset, by id or name; unknown ones give the defaults."""
    for key, (label, own) in BUILTIN.items():
        if name in (key, label):
            return sanitized(own)
    return sanitized({})
