"""Physical constants, residue masses and digestion rules."""

from __future__ import annotations

PROTON = 1.00727646688
WATER = 18.0105646863
AMMONIA = 17.0265491015
PHOSPHORIC = 97.9768955739
#: Mason-Schamp factor for 1/K0 in Vs/cm^2, and the mass of the drift gas (N2).
CCS_FACTOR, GAS_MASS = 1059.62245, 28.0
ELEMENTS = ["C", "H", "N", "O", "S", "P", "Na", "K", "Cl", "Se", "Br", "I", "F", "Fe", "Si", "B", "13C", "15N", "2H", "18O"]
#: Monoisotopic residue masses.
RESIDUE_MASS = {
    "A": 71.037113805, "C": 103.009184505, "D": 115.026943065, "E": 129.042593135, "F": 147.068413945, "G": 57.021463735,
    "H": 137.058911875, "I": 113.084064015, "K": 128.09496305, "L": 113.084064015, "M": 131.040484645, "N": 114.04292747,
    "P": 97.052763875, "Q": 128.05857754, "R": 156.10111105, "S": 87.032028435, "T": 101.047678505, "V": 99.068413945,
    "W": 186.07931298, "Y": 163.063328575,
}
#: By index: name, residues before a cut, residues after a cut, residue that forbids a cut when it follows.
ENZYMES = [
    ("non-specific", "ABCDEFGHIKLMNPQRSTUVWXY", "", ""),
    ("Trypsin", "KR", "", "P"),
    ("Trypsin (no P rule)", "KR", "", ""),
    ("Arg-C", "R", "", "P"),
    ("Arg-C (no P rule)", "R", "", ""),
    ("Arg-N", "", "R", ""),
    ("Glu-C", "E", "", ""),
    ("Lys-C", "K", "", "P"),
    ("Lys-C (no P rule)", "K", "", ""),
    ("Lys-N", "", "K", ""),
    ("Asp-N", "", "D", ""),
    ("Asp-N (ambic)", "", "DE", ""),
    ("Chymotrypsin", "FYWL", "", "P"),
    ("Chymotrypsin (no P rule)", "FYWL", "", ""),
    ("Pepsin A", "FL", "", ""),
    ("CNBr", "M", "", ""),
    ("Thermolysin", "", "AFILMV", ""),
    ("LysargiNase", "", "RK", ""),
    ("NoCut", "", "X", ""),
]
