"""Source fixers and media paths."""

from pyspark.sql import functions as F

from textloom.functions.code import fix_code, fix_cpp
from textloom.operators.alignment import resolve_media


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_fixers(spark):
    fixed = lambda code, lang="python": one(spark, fix_code(F.lit(code), F.lit(lang)))
    sys_ = "import sys\nsys.set_int_max_str_digits(0)\n"
    assert fixed("x = 1") == sys_ + "x = 1"
    assert fixed("import os\nprint(os.getlogin())\r\n") == "import os\n" + sys_ + "print(False)"
    assert fixed("import fractions\nprint(fractions.gcd(4, 6))") == "import fractions\nimport math\n" + sys_ + "print(math.gcd(4, 6))"
    assert fixed("from fractions import gcd, Fraction\ngcd(1, 2)") == "from fractions import Fraction; from math import gcd\n" + sys_ + "gcd(1, 2)"
    assert fixed("from fractions import (Fraction, gcd as g)  # both\n") .startswith("from fractions import Fraction; from math import gcd as g\n")
    assert fixed("from fractions import *\ngcd(1, 2)").startswith("from fractions import *\nfrom math import gcd\n")
    assert fixed("from inspect import getargspec, stack\nf") .startswith("from inspect import getfullargspec as getargspec, stack\n")
    assert fixed("from collections import Mapping, Counter\nx = collections.Set").startswith("from collections import Counter; from collections.abc import Mapping\n")
    assert fixed("from collections import deque\nx = collections.Set").endswith("x = collections.abc.Set")
    assert fixed("import imp\nimport important\ny = asyncio.async(x)") == "import importlib\nimport important\n" + sys_ + "y = asyncio.ensure_future(x)"
    assert fixed("from a import (b,\n  c)\nz") == sys_ + "from a import (b,\n  c)\nz"
    assert fixed("def f():\n    import os\n    return 1") == sys_ + "def f():\n    import os\n    return 1"
    assert fixed("a = array.array('c', 'x')\nb = 1 + \\\n\n  2\\") == sys_ + "a = array.array('b', 'x')\nb = 1 + \\\n  2"
    assert fixed("", "python") == "" and fixed("x", "rust") == "x"
    assert fixed("int main() {}", "C++17") == "#include <bits/stdc++.h>\n\nusing namespace std;\n\nint main() {}"
    assert one(spark, fix_cpp(F.lit("std::x"), F.lit("p1"))) == '#include <bits/stdc++.h>\n#include "p1.h"\nstd::x'


def test_media(spark):
    rows = spark.createDataFrame([(1, ["a.jpg", "b.jpg"]), (2, None), (3, [])], "id int, _images array<string>")
    files = spark.createDataFrame([("file:///m/a.jpg",)], "path string")
    got = {r.id: r._images for r in resolve_media(rows, files, "/m", "id").collect()}
    assert got == {1: ["/m/a.jpg", "b.jpg"], 2: None, 3: None}
