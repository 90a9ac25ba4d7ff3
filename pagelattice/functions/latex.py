"""Cleaning of recognised formulas: ordered rewriting rules, applied by a vectorised function.

Most rules replace one symbol by a command. Symbols of the groups before the asterisk rule and after it are each replaced
in one pass over the text; that a single pass does what the symbols' rules do one after another is tested.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values from here to UNITS: which command stands for which symbol.
GREEK = {
    "α": "alpha",
    "β": "beta",
    "γ": "gamma",
    "δ": "delta",
    "ε": "epsilon",
    "ζ": "zeta",
    "η": "eta",
    "θ": "theta",
    "ι": "iota",
    "κ": "kappa",
    "λ": "lambda",
    "μ": "mu",
    "ν": "nu",
    "ξ": "xi",
    "π": "pi",
    "ρ": "rho",
    "σ": "sigma",
    "τ": "tau",
    "υ": "upsilon",
    "φ": "phi",
    "χ": "chi",
    "ψ": "psi",
    "ω": "omega",
    "ϵ": "varepsilon",
    "ϑ": "vartheta",
    "ϕ": "varphi",
    "ϱ": "varrho",
    "ϖ": "varpi",
    "ϝ": "digamma",
    "ϰ": "varkappa",
    "ς": "varsigma",
    "Γ": "Gamma",
    "Δ": "Delta",
    "Θ": "Theta",
    "Λ": "Lambda",
    "Ξ": "Xi",
    "Π": "Pi",
    "Σ": "Sigma",
    "Υ": "Upsilon",
    "Φ": "Phi",
    "Ψ": "Psi",
    "Ω": "Omega",
    "ℵ": "aleph",
    "ℶ": "beth",
    "ℸ": "daleth",
    "ℷ": "gimel",
}
LARGE = {
    "∑": "sum",
    "∏": "prod",
    "∐": "coprod",
    "∫": "int",
    "∮": "oint",
    "∬": "iint",
    "∭": "iiint",
    "⋂": "bigcap",
    "⋃": "bigcup",
    "⊎": "biguplus",
    "⋁": "bigvee",
    "⋀": "bigwedge",
    "⨆": "bigsqcup",
}
ARROWS = {
    "←": "leftarrow",
    "→": "rightarrow",
    "↑": "uparrow",
    "↓": "downarrow",
    "↔": "leftrightarrow",
    "↕": "updownarrow",
    "⇐": "Leftarrow",
    "⇒": "Rightarrow",
    "⇑": "Uparrow",
    "⇓": "Downarrow",
    "⇔": "Leftrightarrow",
    "⇕": "Updownarrow",
    "↦": "mapsto",
    "↩": "hookleftarrow",
    "↪": "hookrightarrow",
    "↼": "leftharpoonup",
    "↽": "leftharpoondown",
    "⇀": "rightharpoonup",
    "⇁": "rightharpoondown",
    "⇌": "rightleftharpoons",
    "↗": "nearrow",
    "↘": "searrow",
    "↙": "swarrow",
    "↖": "nwarrow",
    "↠": "twoheadrightarrow",
    "↞": "twoheadleftarrow",
    "↣": "rightarrowtail",
    "↢": "leftarrowtail",
    "↻": "circlearrowright",
    "↺": "circlearrowleft",
    "↚": "nleftarrow",
    "↛": "nrightarrow",
    "⇍": "nLeftarrow",
    "⇏": "nRightarrow",
    "⇎": "nLeftrightarrow",
    "⇝": "leadsto",
}
BINARY = {
    "×": "times",
    "÷": "div",
    "±": "pm",
    "∓": "mp",
    "·": "cdot",
    "∘": "circ",
    "•": "bullet",
    "⊕": "oplus",
    "⊗": "otimes",
    "⊖": "ominus",
    "⊘": "oslash",
    "⊙": "odot",
    "†": "dagger",
    "‡": "ddagger",
    "∧": "wedge",
    "∨": "vee",
    "∩": "cap",
    "∪": "cup",
    "⊔": "sqcup",
    "⊓": "sqcap",
    "⊠": "boxtimes",
    "⊞": "boxplus",
    "⊟": "boxminus",
    "⊡": "boxdot",
    "⊻": "veebar",
    "⊼": "barwedge",
    "⋏": "curlywedge",
    "⋎": "curlyvee",
    "⊥": "bot",
    "⊤": "top",
    "⊺": "intercal",
    "△": "bigtriangleup",
    "▽": "bigtriangledown",
    "◁": "triangleleft",
    "▷": "triangleright",
}
RELATIONS = {
    "≡": "equiv",
    "≅": "cong",
    "≈": "approx",
    "∼": "sim",
    "≃": "simeq",
    "≐": "doteq",
    "∝": "propto",
    "∣": "mid",
    "∥": "parallel",
    "⊂": "subset",
    "⊃": "supset",
    "⊆": "subseteq",
    "⊇": "supseteq",
    "⊏": "sqsubset",
    "⊐": "sqsupset",
    "⊑": "sqsubseteq",
    "⊒": "sqsupseteq",
    "∈": "in",
    "∉": "notin",
    "∋": "ni",
    "⊢": "vdash",
    "⊣": "dashv",
    "⊨": "models",
    "≺": "prec",
    "≻": "succ",
    "≼": "preceq",
    "≽": "succeq",
    "≪": "ll",
    "≫": "gg",
    "⌣": "smile",
    "⌢": "frown",
    "∴": "therefore",
    "∵": "because",
    "≠": "neq",
    "≤": "leq",
    "≥": "geq",
    "≦": "leqq",
    "≧": "geqq",
    "⩽": "leqslant",
    "⩾": "geqslant",
    "≁": "nsim",
    "≇": "ncong",
    "∤": "nmid",
    "∦": "nparallel",
    "⊄": "nsubseteq",
    "⊅": "nsupseteq",
    "≮": "nless",
    "≯": "ngtr",
    "≰": "nleq",
    "≱": "ngeq",
}
MISC = {
    "∞": "infty",
    "∇": "nabla",
    "∂": "partial",
    "∀": "forall",
    "∃": "exists",
    "∄": "nexists",
    "∅": "emptyset",
    "∠": "angle",
    "√": "sqrt",
    "…": "ldots",
    "⋯": "cdots",
    "⋮": "vdots",
    "⋱": "ddots",
    "ℏ": "hbar",
    "ℓ": "ell",
    "℘": "wp",
    "ℜ": "Re",
    "ℑ": "Im",
    "♣": "clubsuit",
    "♦": "diamondsuit",
    "♥": "heartsuit",
    "♠": "spadesuit",
    "★": "bigstar",
    "◇": "Diamond",
    "∡": "measuredangle",
    "∢": "sphericalangle",
    "ð": "eth",
    "§": "S",
    "¶": "P",
    "©": "copyright",
    "£": "pounds",
}
PLAIN = {
    "°": r"^{\circ}",
    "′": "'",
    "″": "''",
    "‴": "'''",
}
FUNCTIONS = "arccos arcsin arctan arg cos cosh cot coth csc deg det dim exp gcd hom inf ker lg liminf limsup lim ln log max min Pr sec sin sinh sup tan tanh".split()
UNITS = "kg ms nm km mol rad eV MeV GeV Hz kHz MHz Pa bar".split()
BRACED_ACCENTS = "hat vec bar tilde dot ddot acute grave breve check".split()
BRACED_CONSTRUCTS = "overline underline overbrace underbrace widehat widetilde overrightarrow overleftarrow".split()

FIRST_SYMBOLS = {k: "\\" + v for k, v in (GREEK | LARGE | ARROWS).items()}
SECOND_SYMBOLS = {k: "\\" + v for k, v in (RELATIONS | MISC).items()} | PLAIN


def rules() -> list:
    """The rules in their order: a mapping replaces symbols in one pass, a pair is a pattern and its replacement.

    Patterns and replacements are fixed values.
    """
    braced = [(rf"\\{name}\s*\{{", rf"\\{name}{{") for name in BRACED_ACCENTS]
    built = [(rf"\\{name}\s*\{{", rf"\\{name}{{") for name in BRACED_CONSTRUCTS]
    return [
        (r"^```latex\s*", ""),
        (r"^```\s*", ""),
        (r"```\s*$", ""),
        (r"^\$\$\s*", ""),
        (r"\s*\$\$$", ""),
        (r"^\$\s*", ""),
        (r"\s*\$$", ""),
        (r"\\\\$", ""),
        (r"\\[,:;!]\s*", " "),
        (r"\\quad\s*", " "),
        (r"\\qquad\s*", "  "),
        (r"\\hspace\{[^}]*\}", " "),
        (r"\\vspace\{[^}]*\}", ""),
        (r"~", " "),
        FIRST_SYMBOLS,
        (r"<=>", r"\\Leftrightarrow"),
        (r"(?<![=\-])-+>", r"\\rightarrow"),
        (r"<-+(?![=\-])", r"\\leftarrow"),
        (r"=+>", r"\\Rightarrow"),
        {k: "\\" + v for k, v in BINARY.items()},
        (r"(?<=[A-Za-z0-9}])\s*\*\s*(?=[A-Za-z0-9{\\])", r"\\cdot"),
        {k: "\\" + v for k, v in RELATIONS.items()},
        (r"(?<![<\\])<=(?!=)", r"\\leq"),
        (r"(?<![>\\])>=(?!=)", r"\\geq"),
        (r"(?<![!=])!=", r"\\neq"),
        {k: "\\" + v for k, v in MISC.items()} | PLAIN,
        *braced,
        (r"\\frac\s+\{", r"\\frac{"),
        (r"\\frac\s+(\w)\s+(\w)", r"\\frac{\1}{\2}"),
        (r"\\sqrt\s+(\w)", r"\\sqrt{\1}"),
        (r"\^([A-Za-z0-9]{2,})", r"^{\1}"),
        (r"_([A-Za-z0-9]{2,})", r"_{\1}"),
        (r"_\{\s*\\,\s*", "_{"),
        *built,
        (r"\\left\s*\(", r"\\left("),
        (r"\\right\s*\)", r"\\right)"),
        (r"\\left\s*\[", r"\\left["),
        (r"\\right\s*\]", r"\\right]"),
        (r"\\left\s*\\\{", r"\\left\{"),
        (r"\\right\s*\\\}", r"\\right\}"),
        (r"\{\s+", "{"),
        (r"\s+\}", "}"),
        (r"\\textbf\{([^}]+)\}", r"\\mathbf{\1}"),
        (r"\\text\{([^}]+)\}", r"\\mathrm{\1}"),
        (r"\\mathbb\{([a-z])\}", r"\\mathbf{\1}"),
        (r"\\hat\{\\textbf\{([^}]+)\}\}", r"\\hat{\\mathbf{\1}}"),
        (r"\\mathbf\{([^}=]+)=\}", r"\\mathbf{\1}="),
        (r"\\operatorname\s*\{", r"\\operatorname{"),
        (rf"(?<!\\)\b({'|'.join(FUNCTIONS)})\b(?=\s*[\(\{{])", r"\\\1"),
        (r"\bd\s+([A-Z])\b", r"d\1"),
        (r"\bd\s+([a-z])\b", r"d\1"),
        (rf"(\d)\s*({'|'.join(UNITS)})", r"\1\\,\\mathrm{\2}"),
        (r"\\mathrm\{([A-Z][a-z]?)\}(\d)", r"\\ce{\1\2}"),
        (r"\\rightleftharpoons", r"\\ce{<=>}"),
        (r"\\xrightarrow\{([^}]*)\}", r"\\ce{->[\1]}"),
        (r"\s+", " "),
    ]


def _step(rule):
    if isinstance(rule, dict):
        return lambda s, t=str.maketrans(rule): s.translate(t)
    pattern, replacement = re.compile(rule[0]), rule[1]
    return lambda s: pattern.sub(replacement, s)


_STEPS = [_step(r) for r in rules()]


def clean(expr: str) -> str:
    for step in _STEPS:
        expr = step(expr)
    return expr.strip()


@F.pandas_udf(T.StringType())
def clean_latex(exprs: pd.Series) -> pd.Series:
    """A cleaned formula; null stays null."""
    return exprs.map(lambda s: None if s is None else clean(s))


def symbols(c: Column, table: dict[str, str]) -> Column:
    """The symbols of a table replaced, in JVM expressions."""
    for symbol, command in table.items():
        c = F.replace(c, F.lit(symbol), F.lit(command))
    return c


def bold_blackboard(c: Column) -> Column:
    return F.regexp_replace(c, r"\\mathbb\{([a-zA-Z])\}", r"\\mathbf{$1}")


def roman_text(c: Column) -> Column:
    r"""The plain text of an expression made of \mathrm groups of letters alone; null for any other."""
    words = F.transform(F.regexp_extract_all(c, F.lit(r"\\mathrm\{([^}]+)\}"), F.lit(1)), lambda w: F.regexp_replace(w, r"(?U)^\s+|\s+$", ""))
    joined = F.array_join(F.filter(words, lambda w: w != ""), " ")
    return F.when(c.rlike(r"(?Ud)^(\s*\\mathrm\{[A-Za-z][A-Za-z\s]*\}\s*)+$") & (joined != ""), joined)
