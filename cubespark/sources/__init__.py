"""Reading and writing cubes, attribute tables and geometries."""
