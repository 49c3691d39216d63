"""Part of prismarc."""
