"""Column functions: names, stress and strain kernels, geometry of elements, colour and level arithmetic."""
