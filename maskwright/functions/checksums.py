"""Checksums as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def luhn(value: Column) -> Column:
    """Of the digits in value, whatever stands between them."""
    return F.call_function("luhn_check", F.regexp_replace(value, "[^0-9]", ""))


def iban(value: Column) -> Column:
    """ISO 7064 mod 97-10: the first four characters to the end, letters as 10 to 35, rest 1."""
    plain = F.upper(F.regexp_replace(value, r"\s", ""))
    turned = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
    digit = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + digit(c)).otherwise(acc * 100 + digit(c)) % 97)
    return (F.length(plain) >= 15) & (rest == 1)


def nhs(value: Column) -> Column:
    """Mod 11 over ten digits: weights 10 to 2, check digit 11 minus the rest (11 counts as 0; 10 is invalid)."""
    digits = F.transform(F.regexp_extract_all(value, F.lit("([0-9])"), F.lit(1)), lambda d: d.cast("int"))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(8)), F.lit(0), lambda acc, i: acc + F.get(digits, i) * (10 - i))
    return F.coalesce((F.size(digits) == 10) & (((11 - total % 11) % 11) == F.get(digits, 9)), F.lit(False))


def octets(value: Column) -> Column:
    """Four dotted parts of 255 at most."""
    return F.forall(F.split(value, "[.]"), lambda p: p.cast("int") <= 255)


def _digits(value: Column, weights: list[int]) -> Column:
    """Sum of the digits of value times weights."""
    return sum((F.substring(value, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))


def routing(value: Column) -> Column:
    """Nine digits, weights 3, 7, 1, rest 0 modulo 10, not all zero."""
    return value.rlike("^[0-9]{9}$") & (_digits(value, [3, 7, 1] * 3) % 10 == 0) & (value != "000000000")


def vehicle(value: Column) -> Column:
    """17 characters; letters count by a fixed table, the rest modulo 11 stands at the ninth place, 10 as X."""
    # fixed values: what letters count, and the weights
    plain = F.translate(value, "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789")
    rest = _digits(plain, [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]) % 11
    return value.rlike("^[A-HJ-NPR-Z0-9]{17}$") & (F.substring(value, 9, 1) == F.when(rest == 10, "X").otherwise(rest.cast("string")))


def ipv6(value: Column) -> Column:
    """Eight groups, or fewer with one run of them left out."""
    groups = F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
    gaps = F.regexp_count(value, F.lit("::"))
    ends = ~value.rlike("^:[^:]|[^:]:$|:::")
    return ends & F.when(gaps == 0, groups == 8).otherwise((gaps == 1) & (groups >= 1) & (groups <= 7))


BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def base58check(value: Column) -> Column:
    """25 bytes in base 58, the last four of which are the beginning of the twice hashed others; leading zero bytes are ones.

    The number is held in limbs of 24 bits; each character multiplies it by 58 and adds a digit."""
    limbs, full = 9, (1 << 24) - 1

    def step(acc: Column, c: Column) -> Column:
        carry, out = F.instr(F.lit(BASE58), c).cast("long") - 1, []
        for k in range(limbs):
            now = acc[f"l{k}"] * 58 + carry
            out.append(now.bitwiseAND(F.lit(full)).alias(f"l{k}"))
            carry = F.shiftright(now, 24)
        return F.struct(*out)

    start = F.struct(*(F.lit(0).cast("long").alias(f"l{k}") for k in range(limbs)))
    digits = F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))
    raw = F.aggregate(digits, start, step, lambda acc: F.concat(*(F.lpad(F.hex(acc[f"l{k}"]), 6, "0") for k in reversed(range(limbs)))))
    number = F.substring(raw, 5, 50)
    twice = F.sha2(F.unhex(F.sha2(F.unhex(F.substring(number, 1, 42)), 256)), 256)
    zeros = F.floor((F.length(number) - F.length(F.ltrim(number, F.lit("0")))) / 2)
    ones = F.length(value) - F.length(F.ltrim(value, F.lit("1")))
    return value.rlike(f"^[{BASE58}]{{26,35}}$") & F.startswith(raw, F.lit("0000")) & (zeros == ones) & (F.upper(F.substring(twice, 1, 8)) == F.substring(number, 43, 8))


def bech32(value: Column, prefix: str = "bc") -> Column:
    """Checksum over five-bit values, of the first or the later form; one case only."""
    low = F.lower(value)
    head = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]
    # fixed values: the generator, and the two constants that a checksum must leave
    generator = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)

    def step(acc: Column, v: Column) -> Column:
        out = F.shiftleft(acc.bitwiseAND(F.lit(0x1FFFFFF)), 5).bitwiseXOR(v)
        for i, g in enumerate(generator):
            out = out.bitwiseXOR(F.when(F.shiftright(acc, 25 + i).bitwiseAND(F.lit(1)) == 1, F.lit(g)).otherwise(F.lit(0)).cast("long"))
        return out

    own = F.transform(F.regexp_extract_all(F.substring(low, len(prefix) + 2, 128), F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(BECH32), c).cast("long") - 1)
    values = F.concat(F.array(*(F.lit(x).cast("long") for x in head)), own)
    rest = F.aggregate(values, F.lit(1).cast("long"), step)
    return low.rlike(f"^{prefix}1[{BECH32}]{{11,71}}$") & ((value == low) | (value == F.upper(value))) & rest.isin(1, 0x2BC830A3)


def entropy(value: Column) -> Column:
    """Shannon entropy of a short string's characters, in bits; 0 for the empty one."""
    chars = F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))
    n = F.size(chars)
    each = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)))
    return F.when(n == 0, 0.0).otherwise(F.aggregate(each, F.lit(0.0), lambda acc, k: acc - k / n * F.log2(k / n)))


def secret(value: Column, least: float = 3.0) -> Column:
    """Letters and digits that change often and say much: what generated keys look like and words do not."""
    switches = F.regexp_count(value, F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]"))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (switches * 16 >= F.length(value)) & (entropy(value) >= least)
