"""Scripted overlay templates. Times are functions of the job's duration in seconds.

Columns: variant, position in the script, id, text with named slots, start floor, start share, placed from the
end, length cap, length share, length floor, zone, font size, animation, motion strength, words per chunk, word
seconds, word by word.
"""

# --- fixed values ------------------------------------------------------------------------------------------
TEMPLATE_COLUMNS = (
    "variant string, pos int, id string, template string, start_floor double, start_share double, from_end boolean, "
    "len_cap double, len_share double, len_floor double, position string, font_size int, animation string, "
    "strength double, per_chunk int, word_dur double, word_by_word boolean"
)
TEMPLATES = [
    ("default", 0, "ads-hook", "{hook}", 0.12, 0.0, False, 2.2, 0.16, 0.0, "top", 90, "punch", 0.98, 1, 0.22, True),
    ("default", 1, "ads-offer", "{offer}", 1.5, 0.25, False, 3.0, 0.2, 0.0, "center", 70, "slide-up", 0.9, 2, 0.24, True),
    ("default", 2, "ads-proof", "{proof}", 3.5, 0.52, False, 3.1, 0.2, 0.0, "center", 56, "slide-up", 0.9, 2, 0.24, True),
    ("default", 3, "ads-cta", "{cta}", 0.0, 0.0, True, 2.6, 0.2, 1.8, "bottom", 82, "punch", 1.0, 1, 0.20, True),
    ("ugc", 0, "ads-hook", "{hook}", 0.12, 0.0, False, 2.2, 0.16, 0.0, "top", 84, "punch", 0.98, 1, 0.22, True),
    ("ugc", 1, "ads-offer", "REAL CREATOR FEEL - {offer}", 1.5, 0.25, False, 3.0, 0.2, 0.0, "center", 70, "slide-up", 0.9, 2, 0.24, True),
    ("ugc", 2, "ads-proof", "SOCIAL PROOF + BEFORE/AFTER + TRUST", 3.5, 0.52, False, 3.1, 0.2, 0.0, "center", 56, "slide-up", 0.9, 2, 0.24, True),
    ("ugc", 3, "ads-cta", "TRY THIS CREATIVE NOW", 0.0, 0.0, True, 2.6, 0.2, 1.8, "bottom", 82, "punch", 1.0, 1, 0.20, True),
    ("direct", 0, "ads-hook", "{hook} - THIS IS THE OFFER", 0.12, 0.0, False, 2.2, 0.16, 0.0, "top", 90, "punch", 0.98, 1, 0.22, True),
    ("direct", 1, "ads-offer", "LIMITED TIME - {offer}", 1.5, 0.25, False, 3.0, 0.2, 0.0, "center", 70, "slide-up", 0.9, 2, 0.24, True),
    ("direct", 2, "ads-proof", "CLEAR BENEFIT + NUMBERS + DEADLINE", 3.5, 0.52, False, 3.1, 0.2, 0.0, "center", 56, "slide-up", 0.9, 2, 0.24, True),
    ("direct", 3, "ads-cta", "CLICK NOW - START TODAY", 0.0, 0.0, True, 2.6, 0.2, 1.8, "bottom", 82, "punch", 1.0, 1, 0.20, True),
    ("problem", 0, "ads-hook", "PROBLEM", 0.12, 0.0, False, 2.2, 0.16, 0.0, "top", 90, "punch", 0.98, 1, 0.22, False),
    ("problem", 1, "ads-offer", "AGITATE - WHAT IT COSTS YOU", 1.5, 0.25, False, 3.0, 0.2, 0.0, "center", 70, "slide-up", 0.9, 2, 0.24, True),
    ("problem", 2, "ads-proof", "SOLUTION - EDITOR FLOW", 3.5, 0.52, False, 3.1, 0.2, 0.0, "center", 56, "slide-up", 0.9, 2, 0.24, True),
    ("problem", 3, "ads-cta", "CTA - TEST IT ON YOUR NEXT AD", 0.0, 0.0, True, 2.6, 0.2, 1.8, "bottom", 82, "punch", 1.0, 1, 0.20, True),
    ("v6", 0, "ads-hook", "{hook}", 0.12, 0.0, False, 1.9, 0.14, 0.0, "top", 98, "punch", 1.0, 1, 0.18, True),
    ("v6", 1, "ads-problem", "LOW HOLD RATE = LOST SALES", 1.05, 0.18, False, 1.8, 0.13, 0.0, "center", 72, "punch", 0.98, 2, 0.2, True),
    ("v6", 2, "ads-offer", "{offer}", 2.3, 0.32, False, 2.1, 0.15, 0.0, "center", 74, "slide-up", 0.95, 2, 0.21, True),
    ("v6", 3, "ads-proof", "{proof}", 4.3, 0.5, False, 2.2, 0.16, 0.0, "center", 64, "punch", 0.95, 2, 0.2, True),
    ("v6", 4, "ads-urgency", "LIMITED TIME - BUYERS MOVE FAST", 6.8, 0.69, False, 1.9, 0.14, 0.0, "center", 70, "punch", 1.0, 2, 0.19, True),
    ("v6", 5, "ads-cta", "{cta}", 0.0, 0.0, True, 2.8, 0.2, 0.0, "bottom", 92, "punch", 1.0, 1, 0.18, True),
    ("v7", 0, "ads-hook-v7", "{hook}", 0.08, 0.0, False, 1.6, 0.12, 0.0, "top", 102, "punch", 1.0, 1, 0.15, True),
    ("v7", 1, "ads-problem-v7", "NO MOTION = NO ATTENTION", 0.95, 0.16, False, 1.45, 0.11, 0.0, "center", 74, "punch", 1.0, 2, 0.17, True),
    ("v7", 2, "ads-offer-v7", "{offer}", 2.0, 0.28, False, 1.8, 0.13, 0.0, "center", 78, "slide-up", 0.95, 2, 0.18, True),
    ("v7", 3, "ads-proof-v7", "{proof}", 3.9, 0.47, False, 1.9, 0.14, 0.0, "center", 66, "punch", 0.95, 2, 0.18, True),
    ("v7", 4, "ads-urgency-v7", "LIMITED WINDOW - MOVE NOW", 5.9, 0.64, False, 1.6, 0.12, 0.0, "center", 72, "punch", 1.0, 2, 0.16, True),
    ("v7", 5, "ads-cta-v7", "{cta}", 0.0, 0.0, True, 2.6, 0.19, 0.0, "bottom", 96, "punch", 1.0, 1, 0.16, True),
]
SLOT_DEFAULTS = {
    "hook": "STOP THE SCROLL",
    "offer": "THIS WORKS FOR TIKTOK ADS",
    "proof": "FAST CUTS + KINETIC TEXT + AUTO ZOOMS",
    "cta": "TRY IT NOW",
}
STYLE_VARIANTS = {
    "tiktok-ads": "default",
    "tiktok_ads": "default",
    "tiktok": "default",
    "remotion-ads": "default",
    "tiktok-ads-ugc": "ugc",
    "tiktok_ads_ugc": "ugc",
    "ugc": "ugc",
    "tiktok-ads-direct-response": "direct",
    "tiktok_ads_direct_response": "direct",
    "direct-response": "direct",
    "tiktok-ads-problem-solution": "problem",
    "tiktok_ads_problem_solution": "problem",
    "problem-solution": "problem",
    "tiktok-ads-v6": "v6",
    "tiktok_ads_v6": "v6",
    "tiktok-v6": "v6",
    "remotion-v6": "default",
    "tiktok-ads-v7": "v7",
    "tiktok_ads_v7": "v7",
    "tiktok-v7": "v7",
    "remotion-v7": "default",
}
