"""Parts of the SQL that queries are compared with."""

#: crc_table(crc): the 256 steps of CRC-32 by its polynomial.
CRC_TABLE = """crc_table as (
  select list(c order by i) crc from (select i, list_reduce(list_prepend(i, range(8)), lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) c from range(256) r(i)))"""


def crc_of(text: str) -> str:
    """The CRC-32 of an ASCII text, beside crc_table."""
    codes = f"list_transform(string_split({text}, ''), lambda z: ascii(z)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])), 4294967295)"
