"""Fixed values of the glyph rules."""

# Private-use characters of symbol fonts -> plain characters.
PRIVATE_BULLETS = {
    "\uf0b7": "•", "\uf06c": "•", "\uf09f": "•", "\uf0a7": "▪", "\uf0a8": "◦", "\uf06e": "■", "\uf071": "❑",
    "\uf075": "◆", "\uf076": "❖", "\uf0d8": "➢", "\uf0e0": "→", "\uf0e8": "➔", "\uf0fc": "✓", "\uf0fb": "✗",
    "\uf02d": "-", "\uf0a1": "○", "\uf09e": "·", "\uf0b2": "◇", "\ue00a": "•", "\ue00c": "▪",
}
SYNTHETIC_BITS = 4 | 512
MIDDLE_DOTS = "·‧∙・ㆍ"

# Named entities.
ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'", "nbsp": " "}

# Starts of list rows (bullet, dash, number, letter, Hangul letter, circled number, Roman numeral).
LIST_STARTS = [
    r"[•●○◦▪▫■□◆◇❖➢➤►▶▷✓✔·∙‣⁃]", r"[\-–—*]{S}", r"\(?[0-9]{1,3}[.)]{S}", r"\(?[a-zA-Z][.)]{S}",
    r"\(?[가-힣][.)]{S}", r"[①-⑳㉠-㉭㈀-㈍]", r"[ⅰ-ⅻⅠ-Ⅻ][.)]?{S}",
]
PAGE_NUMBER = (r"^([-–—(\[]?{S}*(?:page|p\.)?{S}*)([0-9]{1,4})"
               r"({S}*(?:/{S}*[0-9]{1,4}|of{S}+[0-9]{1,4})?{S}*(?:쪽|페이지|면)?{S}*[-–—)\]]?)$")
SENTENCE_ENDS = ".?!。？！"
