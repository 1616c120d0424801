"""Integer constants from tokens, language by language."""

from shoreline.sources.declarations import extract_constants

GO = '''// package comment
package keys // trailing

import "fmt"

const Plain = 2048
const Typed int = 0x800 // bits
const A, B = 1, 2
const Sum = 1 + 2
const Text, Num = "a // b", 17
const Neg = -5
/* const Hidden = 3
*/
const (
	Grouped = 0b100000000000
	Octal   int = 0o17
	Iota = iota
	Next
	Multi,
	Lines = 3, 4
	Call = f(1,
		2)
	Raw = `
const Fake = 9
` ; After = 10
	Rune = 'x'
	Under = 1_024
	pkg pkgs.Size = 5
)
func f() {
	const Local = 4
	x := []int{1, 2}
}
const Last = 99'''


def constants(spark, *files):
    df = spark.createDataFrame(list(files), "file string, content string")
    return {(r["file"], r["scope"], r["name"]): r["value"] for r in extract_constants(df).collect()}


def test_go(spark):
    want = {"Plain": 2048, "Typed": 2048, "A": 1, "B": 2, "Num": 17, "Grouped": 2048, "Octal": 15, "Multi": 3,
            "Lines": 4, "After": 10, "Under": 1024, "pkg": 5, "Last": 99}
    assert constants(spark, ("x/a.go", GO)) == {("x/a.go", "keys", n): v for n, v in want.items()}
    assert constants(spark, ("e.go", ""), ("n.go", None), ("c.go", "const")) == {}


def test_java_and_typescript_cross_lines(spark):
    java = "public abstract class Sizes {\n  private static\n  final int  K =\n 2_048 ; static final int BAD = 09;\n" \
           "  static final long L = 5; static final int HEX = 0xFF; static final int NEG = -1; final int F = 3;\n" \
           "  static final int K = 4096;\n}"
    ts = "export const KEY_SIZE: number = 256\nconst AES_LEN =\n 0x80;\nconst lower = 4; const X: string = 5; let B_C = 6\n"
    assert constants(spark, ("J.java", java), ("dir/No.java", "static final int N = 1;"), ("a.b.ts", ts)) == {
        ("J.java", "Sizes", "K"): 4096, ("J.java", "Sizes", "HEX"): 255, ("dir/No.java", "No", "N"): 1,
        ("a.b.ts", "a.b", "KEY_SIZE"): 256, ("a.b.ts", "a.b", "AES_LEN"): 128}


def test_python_lines(spark):
    text = "KEY_BITS = 3_072  # c\n  INNER = 1\n\tTAB = 2\nlower = 3\nX = 4\nAB == 5\nAB_C: int = 6\nAA = BB = 7\nKEY_BITS = 0x400\r\nHEX=0X10"
    assert constants(spark, ("m.py", text)) == {("m.py", "m", "KEY_BITS"): 1024, ("m.py", "m", "HEX"): 16}


def test_c(spark):
    text = """#define A 1
  #define A 2u
#define F(x) 3
#define M 4 \\
  + 5
#define M 6
#define N 7 // c
#define BIG 1'024ULL
static const unsigned long long L = 0x10ull;
const uint32_t W = 32; const size_t Z = 8;
const unsigned U = 9; const char *p = 5; const double D = 1.5;
constexpr int A = 9;
constexpr auto Q = 4;
const int A = 3;
const int L = 1;
enum class Kind : uint8_t { ONE = 1, TWO, THREE = 0b11 };
enum { X = 011, Y = 09 };
int v[] = { Z = 5 };
"""
    want = {"A": 2, "BIG": 1024, "L": 16, "W": 32, "Z": 8, "U": 9, "ONE": 1, "THREE": 3, "X": 9}
    assert constants(spark, ("a.hpp", text)) == {("a.hpp", "", n): v for n, v in want.items()}
