"""The find language: parsing, and plans made of it."""
