"""Element and ion-channel dimensions."""

from __future__ import annotations

# Element symbols by atomic number from 1.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc "
    "Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi "
    "Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
ELEMENTS = {symbol: z for z, symbol in enumerate(SYMBOLS, start=1)}

# Masses of the most common isotope by atomic number from 1, in unified atomic mass units; of elements
# without a natural isotope, those of a long-lived one.
MASSES = dict(zip(SYMBOLS, map(float, """
1.00782503223 4.00260325413 7.0160034366 9.012183065 11.00930536 12.0 14.00307400443 15.99491461957 18.99840316273 19.9924401762
22.989769282 23.985041697 26.98153853 27.97692653465 30.97376199842 31.9720711744 34.968852682 39.9623831237 38.9637064864 39.962590863
44.95590828 47.94794198 50.94395704 51.94050623 54.93804391 55.93493633 58.93319429 57.93534241 62.92959772 63.92914201
68.9255735 73.921177761 74.92159457 79.9165218 78.9183376 83.9114977282 84.9117897379 87.9056125 88.9058403 89.9046977
92.906373 97.90540482 97.9072124 101.9043441 102.905498 105.9034804 106.9050916 113.90336509 114.903878776 119.90220163
120.903812 129.906222748 126.9044719 131.9041550856 132.905451961 137.905247 138.9063563 139.9054431 140.9076576 141.907729
144.9127559 151.9197397 152.921238 157.9241123 158.9253547 163.9291819 164.9303288 165.9302995 168.9342179 173.9388664
174.9407752 179.946557 180.9479958 183.95093092 186.9557501 191.961477 192.9629216 194.9647917 196.96656879 201.9706434
204.9744278 207.9766525 208.9803991 208.9824308 209.9871479 222.0175782 223.019736 226.0254103 227.0277523 232.0380558
231.0358842 238.0507884 237.0481736 244.0642053 243.0613813 247.0703541 247.0703073 251.0795886 252.08298 257.0951061
258.0984315 259.10103 262.10961 267.12179 268.12567 271.13393 272.13826 270.13429 276.15159 281.16451
280.16514 285.17712 284.17873 289.19042 288.19274 293.20449 292.20746 294.21392
""".split()), strict=True))
ELECTRON_MASS = 0.000548579909065
PROTON_MASS = MASSES["H"] - ELECTRON_MASS

# Names and order of the ion channels.
#: (name, index, charge, offset added to the neutral mass); the order is the channels' order.
ION_CHANNELS = (
    ("protonated", 0, 1, PROTON_MASS),
    ("deprotonated", 1, -1, -PROTON_MASS),
    ("sodiated", 2, 1, MASSES["Na"] - ELECTRON_MASS),
    ("potassiated", 3, 1, MASSES["K"] - ELECTRON_MASS),
    ("chloride_retained", 4, -1, MASSES["Cl"] + ELECTRON_MASS),
)
